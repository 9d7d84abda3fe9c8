"""Language of documents by cross-parsing: the language whose sample parses a text into the fewest phrases wins.

A sample of each language's labelled text becomes a suffix automaton, which holds all its substrings. A text is cut
greedily into phrases, each the longest match in the sample from there on (one byte where none begins). A phrase costs
the logarithm of the sample's size, so phrases * log2(size) / length estimates the cross entropy of text and language;
the least wins, at a tie the language with more training documents, then the first by code point. The score is
the winner's share of 2 to the minus cost over all languages.

Text is lower-cased and runs of other characters than letters and marks are one space, so digits, signs and markup
decide nothing. It is parsed as UTF-8 bytes, so scripts need no alphabet, in blocks of BLOCK bytes: a phrase ends where
a block does. All blocks of a batch step through a table of the automaton together.

Learning takes a bounded sample: SAMPLE blocks of PIECE characters a language, those of the least hashes among all
distinct training texts, and the LANGUAGES commonest labels. Every document is judged by its whole text.

Edge cases: null text, or text without a letter, is und with score 0; so is everything if nothing can be learned; a
null label isn't learned from; one learned language gets every text, with score 1; copies of a text count once in the
sample; a null doc_id is hashed as the empty text; an empty table gives an empty result. Columns other than doc_id,
text and lang are ignored; lang is read for learning only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import slices, text_bytes

#: Sample of a language: blocks, and characters of each.
SAMPLE, PIECE = 64, 512
#: Labels that are learned at most.
LANGUAGES = 256
#: Bytes that are parsed from a fresh start.
BLOCK = 1024
#: So many times the sample is asked for, as its size is only known about.
SPARE = 8
#: Cells of automaton tables that a task keeps; beyond it tables are built again for each slice of a batch.
CELLS = 1 << 25
UNKNOWN = "und"
LETTER = r"\p{L}"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def plain(text: Column) -> Column:
    """Lower-case letters and marks, a space for each run of anything else, and one on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def sample(docs: DataFrame, blocks: int = SAMPLE) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(lang, h, piece) with at most blocks rows a language, and the labels with their training documents."""
    spark = docs.sparkSession
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    pieces = F.ceil(F.length("text") / PIECE)
    sizes = train.groupBy("lang").agg(F.count("*").alias("n"), (F.approx_count_distinct(F.xxhash64("text")) * F.avg(pieces)).alias("blocks"))
    known = sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not known:
        return spark.createDataFrame([], "lang string, h long, piece string"), []
    # A piece is kept if its hash is below the share of all pieces that is wanted: at most LANGUAGES rows decide that.
    most = spark.createDataFrame([(r.lang, int(min(1.0, SPARE * blocks / max(r.blocks, 1.0)) * 2**62)) for r in known], "lang string, most long")
    chosen = F.filter(F.transform(F.sequence(F.lit(0), pieces.cast("int") - 1), lambda i: F.struct(i.alias("i"), F.shiftright(F.xxhash64(F.col("key"), i), 1).bitwiseAND(F.lit(2**62 - 1)).alias("h"))), lambda x: x["h"] < F.col("most"))
    kept = train.select("lang", "text", F.xxhash64("text").alias("key")).join(F.broadcast(most), "lang").select("lang", "text", F.explode(chosen).alias("x"))
    cut = kept.select("lang", F.col("x.h").alias("h"), plain(F.substring(F.col("text"), F.col("x.i") * PIECE + 1, F.lit(PIECE))).alias("piece"))
    distinct = cut.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    first = distinct.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("place") <= blocks)
    return first.drop("place"), [(r.lang, r.n) for r in known]


def automaton(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton's edges (state, byte, next state); states are numbered by their longest match, the start is 0."""
    next_, link, length = [{}], [-1], [0]
    last = 0
    for c in data:
        now = len(next_)
        next_.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in next_[p]:
            next_[p][c] = now
            p = link[p]
        if p >= 0:
            q = next_[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(next_)
                next_.append(dict(next_[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and next_[p].get(c) == q:
                    next_[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    place = np.empty(len(next_), np.int32)
    place[np.argsort(length, kind="stable")] = np.arange(len(next_))
    state = np.repeat(place, [len(x) for x in next_])
    byte = np.fromiter((c for x in next_ for c in x), np.uint8, len(state))
    to = np.fromiter((t for x in next_ for t in x.values()), np.int32, len(state))
    return state, byte, place[to]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    data = b"\0".join(x.encode() for x in pdf.sort_values("h").piece)
    edges = [x.tobytes() for x in automaton(data)]
    return pd.DataFrame([(pdf.lang.iloc[0], len(data), *edges)], columns=["lang", "size", "state", "byte", "next"])


class Model:
    """Automata of a few languages, as edges; tables for parsing are made in the tasks."""

    def __init__(self, rows: list[tuple[str, int, bytes, bytes, bytes]]):
        self.rows = rows
        self.langs = [r[0] for r in rows]
        self.cost = np.array([np.log2(max(r[1], 2)) for r in rows])
        self.edges = [tuple(np.frombuffer(x, kind) for x, kind in zip(r[2:], (np.int32, np.uint8, np.int32), strict=True)) for r in rows]
        used = sorted(set().union(*(set(e[1].tolist()) for e in self.edges))) if rows else []
        self.width = len(used) + 1
        #: Number of each byte; bytes that no sample has share the last.
        self.code = np.full(256, len(used), np.int32)
        self.code[used] = np.arange(len(used))
        self.tables: dict[int, np.ndarray] = {}

    def table(self, k: int) -> np.ndarray:
        """Where a state (its row times the width) goes with a byte, doubled, plus 1 if a new phrase begins there. A
        missing edge begins one at the start state, as does every step from there."""
        if k in self.tables:
            return self.tables[k]
        state, byte, to = self.edges[k]
        start = np.ones(self.width, np.int32)
        first = state == 0
        start[self.code[byte[first]]] = to[first] * self.width * 2 + 1
        made = np.tile(start, (int(max(state.max(), to.max())) + 1, 1))
        made[state[~first], self.code[byte[~first]]] = to[~first] * self.width * 2
        made = made.reshape(-1)
        if sum(map(len, self.tables.values())) + len(made) <= CELLS:
            self.tables[k] = made
        return made

    def phrases(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Phrases of each text (bytes from rows[i] to rows[i + 1]) in each language."""
        blocks = -(-np.diff(rows) // BLOCK)
        owner = np.repeat(np.arange(len(blocks)), blocks)
        start = rows[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        size = np.minimum(rows[owner + 1] - start, BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        active = np.searchsorted(-size, -np.arange(BLOCK), "left")
        out = np.zeros((len(blocks), len(self.langs)), np.int64)
        code = self.code[data]
        for k in range(len(self.langs)):
            table, at, count = self.table(k), np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
            for t in range(int(size[0]) if len(size) else 0):
                n = active[t]
                now = at[:n]
                np.right_shift(now, 1, out=now)
                now += code[start[:n] + t]
                np.take(table, now, out=now, mode="clip")
                count[:n] += now & 1
            out[:, k] = np.bincount(owner[order], weights=count, minlength=len(blocks)).astype(np.int64)
        return out

    def judge(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the winner, its score and its entropy (bits a byte)."""
        bits = phrases * self.cost
        best = bits.argmin(1)
        least = np.take_along_axis(bits, best[:, None], 1)
        return best, 1 / np.exp2(np.maximum(least - bits, -1000)).sum(1), least[:, 0] / np.maximum(sizes, 1)


def fit(docs: DataFrame, blocks: int = SAMPLE) -> Model:
    """Learns from the documents that aren't held out. The driver gets the automata: at most 3 edges of 9 bytes for each byte of LANGUAGES samples."""
    pieces, known = sample(docs, blocks)
    built = {r.lang: tuple(r) for r in pieces.groupBy("lang").applyInPandas(_build, "lang string, size long, state binary, byte binary, next binary").collect()} if known else {}
    return Model([built[lang] for lang, _ in known if lang in built])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            for part in slices(batch, "plain"):
                data, rows = text_bytes(part.column("plain"))
                sizes = np.diff(rows)
                if model.langs:
                    best, score, entropy = model.judge(model.phrases(data, rows), sizes)
                    known = sizes > 0
                else:
                    best, score, entropy, known = (np.zeros(len(sizes), int), *np.zeros((2, len(sizes))), np.zeros(len(sizes), bool))
                langs = pa.array([model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), langs, pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, entropy, 0.0), mask=~known)], ["doc_id", "held_out", "lang_pred", "score", "entropy"])

    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("text").rlike(LETTER), plain(F.col("text"))).alias("plain"))
    return texts.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, entropy double")


def identify(docs: DataFrame) -> DataFrame:
    """fit() and predict() on the same documents."""
    return predict(docs, fit(docs))
