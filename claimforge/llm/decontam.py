"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Words (A-Z lower-cased) of documents and benchmark items meet in seeds of ``least`` words. A pair whose
seeds cover too little of the item is settled at once; for the others the longest non-overlapping common
runs of words are marked again and again, longest first, down to runs of ``least`` words. A document
that covers ``threshold`` of an item's words, in whatever order, is contaminated by it.

The benchmark is a stated query set. It is read in blocks of about BLOCK_CHARS characters, each small
enough for the driver and for every task. A larger benchmark means one pass over the documents for
each block, whose result is written to the shared folder before the next block is read; so driver and
tasks hold one block at a time. The documents are never shuffled.

Edge cases: null or empty texts match nothing; items with fewer words than ``least`` are in no document;
equal items are all reported; repeated rows are judged alike; empty tables give no matches. Columns
other than doc_id and text pass through tiled() untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import removed, shared_path
from .kernels import U, Words, shingles, slices

LEAST, THRESHOLD = 3, 0.6
BLOCK_CHARS = 16_000_000
#: Matches of seeds that a task holds at once.
UNFOLD = 1 << 21
#: Karp-Rabin starts with runs of this many words.
FIRST_LENGTH = 20
HITS = "_cf_hits"
HIT_TYPE = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType())]))


class _Item:
    __slots__ = ("id", "words")

    def __init__(self, item_id: int | None, words: list[int]):
        self.id, self.words = item_id, words


def _runs(words: list[int], free: list[bool], length: int, step: int = 1_000_003, mask: int = 2**64 - 1) -> Iterator[tuple[int, int]]:
    """Rolling Karp-Rabin hash and start of every unmarked run of length words."""
    top, h, n = pow(step, length, 2**64), 0, 0
    for i, w in enumerate(words):
        if not free[i]:
            h = n = 0
            continue
        h, n = (h * step + w) & mask, n + 1
        if n > length:
            h, n = (h - words[i - length] * top) & mask, length
        if n == length:
            yield h, i - length + 1


def tiled_words(item: list[int], text: list[int], free_text: list[bool], least: int) -> int:
    """Words of item that greedy tiling finds in text; free_text is False where nothing can match."""
    free_item, free_text, covered = [True] * len(item), list(free_text), 0
    length = max(least, min(FIRST_LENGTH, len(item)))
    while True:
        starts = defaultdict(list)
        for h, i in _runs(text, free_text, length):
            starts[h].append(i)
        found = []
        for h, p in _runs(item, free_item, length):
            for t in starts.get(h, ()):
                if p and t and item[p - 1] == text[t - 1] and free_item[p - 1] and free_text[t - 1]:
                    continue  # part of the match that begins a word before
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and free_item[p + n] and free_text[t + n]:
                    n += 1
                if n >= length:
                    found.append((-n, p, t))
        if found and -min(found)[0] > 2 * length:
            length = -min(found)[0]
            continue
        blocked = 0
        for n, p, t in sorted(found):
            if n > blocked:
                break  # what is left of a blocked match may be longer
            if all(free_item[p : p - n]) and all(free_text[t : t - n]):
                free_item[p : p - n] = free_text[t : t - n] = [False] * -n
                covered -= n
            else:
                blocked = min(blocked, n)
        if found:
            continue
        if length == least:
            return covered
        length = max(least, length // 2)


class _Block:
    """Items of a block and where their seeds are."""

    def __init__(self, rows: list[tuple[int | None, str | None]], least: int, threshold: float):
        self.least, self.threshold = least, threshold
        words = Words(pa.array([t for _, t in rows], pa.string()))
        self.items = [_Item(i, words.hash[a:b].tolist()) for (i, _), a, b in zip(rows, words.ptr, words.ptr[1:], strict=False)]
        seeds = [(h, i, p) for i, (a, b) in enumerate(zip(words.ptr, words.ptr[1:], strict=False)) for p, h in enumerate(shingles(words.hash[a:b], least).tolist())]
        seeds.sort()
        self.seed = np.array([x[0] for x in seeds], U)
        self.seed_item = np.array([x[1] for x in seeds], np.int64)
        self.seed_place = np.array([x[2] for x in seeds], np.int64)
        self.bits = max(12, (len(seeds) * 64).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.seed >> U(64 - self.bits)] = True

    def hits(self, words: Words) -> dict[int, list[tuple[int | None, float]]]:
        """Items that cover enough, by row."""
        found: dict[int, list[tuple[int | None, float]]] = defaultdict(list)
        grams = shingles(words.hash, self.least)
        if not len(grams) or not len(self.seed):
            return found
        at = np.flatnonzero(self.maybe[grams >> U(64 - self.bits)])
        low = np.searchsorted(self.seed, grams[at], "left")
        n = np.searchsorted(self.seed, grams[at], "right") - low
        row = np.searchsorted(words.ptr, at, "right") - 1
        n[at + self.least > words.ptr[row + 1]] = 0  # the gram runs into the next row
        at, row, low, n = at[n > 0], row[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return found
        # Rows go together as long as their matches are few; a row with more goes alone.
        edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        total = np.add.reduceat(n, edge)
        group = np.cumsum(total) // UNFOLD
        starts = edge[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
        for a, b in zip(starts, np.r_[starts[1:], len(at)], strict=True):
            part = (at[a:b], row[a:b], low[a:b], n[a:b])
            if part[3].sum() <= 2 * UNFOLD:
                self._judged(words, *self._unfolded(*part), found)
                continue
            for own in edge[(edge >= a) & (edge < b)]:
                end = own + np.searchsorted(row[own:b], row[own], "right")
                self._split(words, at[own:end], row[own:end], low[own:end], n[own:end], found)
        return found

    def _unfolded(self, at: np.ndarray, row: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, place, item and place in the item of every match."""
        seed = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(row, n), np.repeat(at, n), self.seed_item[seed], self.seed_place[seed]

    def _split(self, words: Words, at: np.ndarray, row: np.ndarray, low: np.ndarray, n: np.ndarray, found: dict) -> None:
        """One row with many matches, as common phrases make: matches are counted by item first, then unfolded for a few items at a time of
        those that they can cover enough."""
        piece = np.cumsum(n) // UNFOLD
        cuts = np.r_[np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]), len(at)]
        parts = [(at[a:b], row[a:b], low[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        counts = np.zeros(len(self.items), np.int64)
        for p in parts:
            counts += np.bincount(self._unfolded(*p)[2], minlength=len(counts))
        likely = np.flatnonzero(counts * self.least >= self.threshold * np.array([len(x.words) for x in self.items]) - 1e-9)
        likely = likely[counts[likely] > 0]
        batch = np.cumsum(counts[likely]) // UNFOLD
        for k in np.unique(batch):
            mine = np.zeros(len(counts), bool)
            mine[likely[batch == k]] = True
            kept = [tuple(x[mine[u[2]]] for x in u) for u in map(lambda p: self._unfolded(*p), parts)]
            self._judged(words, *(np.concatenate(x) for x in zip(*kept, strict=True)), found)

    def _judged(self, words: Words, row: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray, found: dict) -> None:
        """Tiles each row and item of the matches whose seeds can cover enough."""
        if not len(row):
            return
        order = np.lexsort((place, item, row))
        row, at, item, place = row[order], at[order], item[order], place[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
        for a, b in zip(first, np.r_[first[1:], len(row)], strict=True):
            r, it = int(row[a]), self.items[item[a]]
            need = self.threshold * len(it.words)
            if np.minimum(np.diff(place[a:b], append=place[b - 1] + self.least), self.least).sum() < need:
                continue
            lo, hi = int(at[a:b].min()), int(at[a:b].max()) + self.least
            free = np.zeros(hi - lo, bool)
            for d in range(self.least):
                free[at[a:b] - lo + d] = True
            covered = tiled_words(it.words, words.hash[lo:hi].tolist(), free.tolist(), self.least)
            if covered >= need:
                found[r].append((it.id, covered / len(it.words)))


def _tile(block: list[tuple[int | None, str | None]], least: int, threshold: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Block(block, least, threshold)
        for batch in batches:
            for part in slices(batch, "text"):
                new = items.hits(Words(part.column("text")))
                old = part.column(HITS).to_pylist()
                both = pa.array([(old[i] or []) + [{"item_id": k, "coverage": c} for k, c in new.get(i, ())] for i in range(part.num_rows)], kind)
                at = part.schema.get_field_index(HITS)
                yield pa.RecordBatch.from_arrays([both if i == at else part.column(i) for i in range(part.num_columns)], part.schema.names)

    return run


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[tuple[list[tuple[int | None, str | None]], bool]]:
    """The benchmark in parts of about chars characters, one at a time; and whether more follow."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // chars) + 1
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in part.collect()], i + 1 < n


def tiled(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with the items that contaminate each row, as array<item_id, coverage> in the column _cf_hits."""
    spark, out, path = docs.sparkSession, docs.withColumn(HITS, F.array().cast(HIT_TYPE)), None
    schema = T.StructType([*docs.schema.fields, T.StructField(HITS, HIT_TYPE)])
    for block, more in blocks(benchmark, block_chars):
        out = out.mapInArrow(_tile(block, least, threshold), schema)
        if more:
            before, path = path, shared_path(spark, "tiled")
            out.write.parquet(path)
            out = spark.read.schema(schema).parquet(path)
            if before:
                removed(spark, before)
    return out


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, contaminated, n_items, max_coverage (0 if none), items (ids in order, comma-joined)."""
    hits = F.col(HITS)
    return tiled(docs.select("doc_id", "text"), benchmark, **how).select(
        "doc_id",
        (F.size(hits) > 0).alias("contaminated"),
        F.size(hits).cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform(hits, lambda x: x["coverage"])), F.lit(0.0)).alias("max_coverage"),
        F.array_join(F.array_sort(F.transform(hits, lambda x: x["item_id"])), ",").alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that no item contaminates."""
    return tiled(docs, benchmark, **how).filter(F.size(HITS) == 0).drop(HITS)
