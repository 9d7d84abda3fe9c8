"""Language-model scoring with a causal self-attention model over subword ids, trained in numpy.

Text is its words (A-Z lower-cased), each with a space before it, cut by a public byte-level BPE, and
one end mark. The SLOTS most frequent ids of the training documents have a slot of their own, the
others share one and are told apart by their counts, so every text has a proper probability. The next
slot is predicted in two steps (class, then member) from

* counts of slot pairs over all training documents, smoothed by single counts, and
* one causal self-attention head over the last WINDOW ids, trained to correct them: keys, values and
  queries are vectors of the ids, distances have a bias, and ids of other documents are masked.

Training is data-parallel: the windows of WINDOW ids that tile every training document, the shorter last
one included, go in a seeded order through Adam. Texts are dealt to tasks and ordered by their hash, about
TASK_CHARS to a task, so neither files nor cluster matter; the tasks' weights are averaged after each of
ROUNDS rounds (the texts are dealt to these, too) and the next round begins with them.
Scoring goes over windows of WINDOW ids of a text, each HALF ids after the one before; the last HALF ids are
scored, so each id is scored once and sees the ids before it, WINDOW - HALF or more of them or all.

The base score is a word unigram. Counts of frequent words (at most FREQUENT) go to every task; the
other words of a document are counted by a join, so all counts are exact and over all documents.

Edge cases: null and empty texts have the end mark only; a null doc_id counts as the empty text in the
crc32, so it is held out; without training documents counts are zero and all slots equally likely; an
empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .kernels import U, Words, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASSES = 32
SLOTS = CLASSES * CLASSES
WINDOW, HALF, WIDTH = 32, 16, 16
BATCH, RATE, SEED = 64, 0.01, 9
FREQUENT = 1 << 18
PAIR_SMOOTH = 20.0
CHUNK = 4096
ROUNDS, TASK_CHARS = 2, 1 << 24
#: Words whose ids a task remembers.
REMEMBER = 400_000
_END_WORD = U(0x5851F42D4C957F2D)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Subwords:
    """Ids of words, remembered by word hash."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.end = max(ranks.values()) + 1
        self._encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[int, list[int]] = {}

    def of(self, words: Words, used: np.ndarray, at: np.ndarray) -> list[list[int]]:
        """Ids of the distinct words used (hashes), first found at the word numbers at."""
        if len(self._known) > REMEMBER:
            self._known.clear()
        known, data, out = self._known, words.data, []
        for h, i in zip(used.tolist(), at.tolist(), strict=True):
            ids = known.get(h)
            if ids is None:
                ids = known[h] = self._encode(" " + data[words.starts[i] : words.ends[i]].tobytes().lower().decode("utf-8", "replace"))
            out.append(ids)
        return out


class Stream:
    """The ids of all rows of a text column, each row ended by the end mark; and its distinct words."""

    def __init__(self, texts: pa.Array, subwords: Subwords):
        words = Words(texts)
        self.rows = len(texts)
        self.used, at, self.inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        ids = [*subwords.of(words, self.used, at), [subwords.end]]
        self.word_ptr = words.ptr
        # Words in order, with the end mark (the last of the distinct ones) after each row.
        n = words.ptr[1:] - words.ptr[:-1]
        order = np.full(len(self.inverse) + self.rows, len(ids) - 1)
        is_word = np.ones(len(order), bool)
        is_word[np.cumsum(n + 1) - 1] = False
        order[is_word] = self.inverse
        self.order = order
        self.lens = np.array([len(x) for x in ids])
        self.flat = np.fromiter((i for x in ids for i in x), np.int64, int(self.lens.sum()))
        self.first = np.cumsum(self.lens) - self.lens
        self.ends = np.cumsum(n + 1)

    def expand(self) -> None:
        """ids, and where each row's begin (ptr)."""
        size = self.lens[self.order]
        first = self.first[self.order]
        self.ids = self.flat[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
        self.ptr = np.concatenate([[0], np.cumsum(size)[self.ends - 1]])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


class _Tally:
    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 2_000_000:
            k, c = _merged(self.keys, self.counts)
            self.keys, self.counts, self.size = [k], [c], len(k) // 2

    def rows(self, kind: int) -> Iterator[pa.RecordBatch]:
        k, c = _merged(self.keys, self.counts)
        for a in range(0, len(k), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[a : a + 50_000]), kind, np.int32)), pa.array(k[a : a + 50_000]), pa.array(c[a : a + 50_000])], ["kind", "key", "n"])


def _count(vocabulary: bytes):
    """Words (kind 0, by hash) and pairs of ids (kind 1, previous * 2**20 + id).

    Pairs inside words are counted once a distinct word, so only pairs across words need the text's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, words, pairs = Subwords(vocabulary), _Tally(), _Tally()
        for batch in batches:
            for part in slices(batch, "text"):
                s = Stream(part.column("text"), subwords)
                n = np.bincount(s.inverse, minlength=len(s.used))
                words.add(s.used.view(np.int64), n)
                words.add(np.array([_END_WORD]).view(np.int64), np.array([s.rows]))
                inside = np.flatnonzero(np.repeat(np.arange(len(s.lens)), s.lens)[1:] == np.repeat(np.arange(len(s.lens)), s.lens)[:-1])
                owner = np.repeat(np.arange(len(s.lens)), s.lens)[inside]
                pairs.add(*_merged([(s.flat[inside] << 20) + s.flat[inside + 1]], [np.append(n, s.rows)[owner]]))
                last, first = s.flat[s.first + s.lens - 1], s.flat[s.first]
                before = np.concatenate([[subwords.end], last[s.order[:-1]]])
                pairs.add(*np.unique((before << 20) + first[s.order], return_counts=True))
        yield from words.rows(0)
        yield from pairs.rows(1)

    return run


class Attention:
    """The head and the two-step output. params: queries, keys, values and members by slot, classes, distances."""

    def __init__(self, log_pairs: np.ndarray, params: dict[str, np.ndarray] | None = None):
        # log_pairs[previous, slot]; slots of class c are c * CLASSES and following.
        by_class = log_pairs.reshape(SLOTS, CLASSES, CLASSES)
        top = by_class.max(2, keepdims=True)
        self.class_bias = (top[..., 0] + np.log(np.exp(by_class - top).sum(2))).astype(np.float32)
        self.member_bias = by_class.astype(np.float32)
        self.params = params or self.start()

    @staticmethod
    def start() -> dict[str, np.ndarray]:
        random = np.random.Generator(np.random.PCG64(SEED))
        draw = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
        return {"queries": draw(SLOTS, WIDTH), "keys": draw(SLOTS, WIDTH), "values": draw(SLOTS, WIDTH), "members": np.zeros((SLOTS, WIDTH), np.float32), "classes": np.zeros((CLASSES, WIDTH), np.float32), "distances": np.zeros(WINDOW, np.float32)}

    def head(self, inputs: np.ndarray, rows: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray]:
        """Attention weights and mixed values for the last positions of each window."""
        p, b = self.params, WINDOW - queries
        scores = p["queries"][inputs[:, b:]] @ p["keys"][inputs].transpose(0, 2, 1)
        distance = np.arange(b, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        scores += p["distances"][np.maximum(distance, 0)]
        scores[(rows[:, b:, None] != rows[:, None, :]) | (distance < 0)] = -1e9
        scores -= scores.max(2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(2, keepdims=True)
        return scores, scores @ p["values"][inputs]

    @staticmethod
    def _soft(x: np.ndarray) -> np.ndarray:
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def output(self, mixed: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all classes, and of the members of each target's class."""
        classes = self._soft(mixed @ self.params["classes"].T + self.class_bias[before])
        kind = after // CLASSES
        members = self.member_bias[before, kind]
        order, blocks = self._by_class(kind)
        mixed, logits = mixed[order], np.empty_like(members)
        for own, c in blocks:
            logits[own] = mixed[own] @ self.params["members"][c].T
        members[order] += logits
        return classes, self._soft(members)

    @staticmethod
    def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """An order by class; and for each class found, its places in that order and its slots."""
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
        return order, [(slice(edges[c], edges[c + 1]), slice(c * CLASSES, (c + 1) * CLASSES)) for c in range(CLASSES) if edges[c] < edges[c + 1]]

    def mixed(self, inputs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """As head() for the last HALF positions, without keeping the weights."""
        p, b = self.params, WINDOW - HALF
        distance = np.arange(b, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        bias = np.where(distance < 0, np.float32(-1e9), p["distances"][np.maximum(distance, 0)])
        scores = p["queries"][inputs[:, b:]] @ p["keys"][inputs].transpose(0, 2, 1)
        scores += bias
        several = np.flatnonzero((rows != rows[:, :1]).any(1))  # windows with more than one document
        scores[several] -= np.float32(1e9) * (rows[several, b:, None] != rows[several, None, :])
        if scores.max() > 60:
            scores -= scores.max(2, keepdims=True)
        np.exp(scores, out=scores)
        return (scores @ p["values"][inputs]) / scores.sum(2, keepdims=True)

    def logs(self, slots: np.ndarray, rows: np.ndarray, end: int) -> np.ndarray:
        """Natural log-probability of every slot of a stream (row numbers in rows), each scored once. Every row
        begins a window's last half, so its scores don't depend on its neighbours."""
        p = self.params
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.empty(0, np.int64)
        lens = np.diff(np.append(first, len(rows)))
        room = -(-lens // HALF) * HALF
        place = np.arange(len(rows)) + np.repeat(np.cumsum(room) - room - first, lens)
        n = int(room.sum())
        inputs, owner, after_all = np.full(n + WINDOW - HALF, end), np.full(n + WINDOW - HALF, -1), np.full(n, end)
        before = np.concatenate([[end], slots[:-1]])[: len(slots)]
        before[first] = end
        inputs[place + WINDOW - HALF], owner[place + WINDOW - HALF], after_all[place] = before, rows, slots
        out = np.empty(n, np.float32)
        inputs = np.lib.stride_tricks.sliding_window_view(inputs, WINDOW)[::HALF]
        owner = np.lib.stride_tricks.sliding_window_view(owner, WINDOW)[::HALF]
        for a in range(0, len(inputs), 512):
            x = inputs[a : a + 512]
            mixed = self.mixed(x, owner[a : a + 512]).reshape(-1, WIDTH)
            m = min(n - a * HALF, len(mixed))
            mixed, before, after = mixed[:m], x[:, WINDOW - HALF :].reshape(-1)[:m], after_all[a * HALF : a * HALF + m]
            # In the order of the targets' classes, so that each class is one product.
            order = np.argsort((after // CLASSES).astype(np.uint8), kind="stable")
            mixed, before, after = mixed[order], before[order], after[order]
            kind, at = after // CLASSES, np.arange(m)
            classes, members = mixed @ p["classes"].T, self.member_bias[before, kind]
            classes += self.class_bias[before]
            edges = np.searchsorted(kind, np.arange(CLASSES + 1))
            for c in np.flatnonzero(np.diff(edges)):
                members[edges[c] : edges[c + 1]] += mixed[edges[c] : edges[c + 1]] @ p["members"][c * CLASSES : (c + 1) * CLASSES].T
            total = np.zeros(m, np.float32)
            for logits, target in ((classes, kind), (members, after % CLASSES)):
                if logits.max() > 60:
                    logits -= logits.max(1, keepdims=True)
                total += logits[at, target] - np.log(np.exp(logits).sum(1))
            out[a * HALF + order] = total
        return out[place]

    def gradient(self, inputs: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over the positions with rows >= 0."""
        p = self.params
        weights, mixed = self.head(inputs, rows, WINDOW)
        # In the order of the targets' classes, so that each class is one product.
        order, blocks = self._by_class(targets.reshape(-1) // CLASSES)
        flat, before, after = mixed.reshape(-1, WIDTH)[order], inputs.reshape(-1)[order], targets.reshape(-1)[order]
        classes, members = self.output(flat, before, after)
        at = np.arange(len(after))
        live = (rows.reshape(-1)[order] >= 0).astype(np.float32)[:, None]
        classes[at, after // CLASSES] -= 1
        members[at, after % CLASSES] -= 1
        scale = live / max(1.0, float(live.sum()))
        classes *= scale
        members *= scale
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["classes"] = classes.T @ flat
        sorted_down = classes @ p["classes"]
        for own, c in blocks:
            g["members"][c] = members[own].T @ flat[own]
            sorted_down[own] += members[own] @ p["members"][c]
        down = np.empty_like(sorted_down)
        down[order] = sorted_down
        down = down.reshape(mixed.shape)
        v, k, q = p["values"][inputs], p["keys"][inputs], p["queries"][inputs]
        dw = down @ v.transpose(0, 2, 1)
        ds = weights * (dw - (dw * weights).sum(2, keepdims=True))
        # Sums by slot, of the three tables at once.
        order = np.argsort(inputs.reshape(-1).astype(np.uint16), kind="stable")
        slot = inputs.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        sums = np.add.reduceat(np.concatenate([weights.transpose(0, 2, 1) @ down, ds @ k, ds.transpose(0, 2, 1) @ q], 2).reshape(-1, 3 * WIDTH)[order], first, axis=0)
        for i, name in enumerate(("values", "queries", "keys")):
            g[name][slot[first]] = sums[:, i * WIDTH : (i + 1) * WIDTH]
        distance = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        g["distances"] = np.bincount(np.maximum(distance, 0).reshape(-1), ds.sum(0).reshape(-1), WINDOW).astype(np.float32)
        return g


def new_model(vocabulary: bytes, end: int, id_counts: np.ndarray, pairs: np.ndarray) -> SimpleNamespace:
    """What tasks get: slots of ids, counts of ids without a slot, of pairs of slots, and weights."""
    model = SimpleNamespace(vocabulary=vocabulary, end=end)
    order = np.argsort(-id_counts, kind="stable")
    order = order[order != end][: SLOTS - 2]
    model.slot = np.zeros(end + 1, np.int64)  # slot 0: all other ids
    # Frequent slots are dealt over the classes, which makes both steps easy.
    model.slot[[end, *order.tolist()]] = np.arange(1, len(order) + 2) % CLASSES * CLASSES + np.arange(1, len(order) + 2) // CLASSES
    other = model.slot == 0
    rest = np.where(other, id_counts, 0) + 0.1
    model.log_rest = np.where(other, np.log(rest / rest[other].sum()), 0.0)
    table = np.zeros((SLOTS, SLOTS))
    if len(pairs):
        np.add.at(table, (model.slot[pairs[:, 0]], model.slot[pairs[:, 1]]), pairs[:, 2])
    single = (table.sum(0) + 0.1) / (table.sum() + 0.1 * SLOTS)
    model.log_pairs = np.log((table + PAIR_SMOOTH * single) / (table.sum(1, keepdims=True) + PAIR_SMOOTH)).astype(np.float32)
    model.params = Attention.start()
    return model


def _windows(slots: np.ndarray, ptr: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, row marks (-1: no position) and targets of the windows that tile each row of a stream."""
    each = -(-np.diff(ptr) // WINDOW)
    row = np.repeat(np.arange(len(each)), each)
    at = (ptr[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)))[:, None] + np.arange(WINDOW)
    out = at >= ptr[row + 1][:, None]
    at[out] = 0
    inputs, targets = np.concatenate([[end], slots[:-1]])[at], slots[at]  # before a row stands the end mark of the last one
    inputs[out] = targets[out] = end
    return inputs, -out.astype(np.int64), targets


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        subwords, net = Subwords(model.vocabulary), Attention(model.log_pairs, {k: v.copy() for k, v in model.params.items()})
        end, random = int(model.slot[model.end]), np.random.Generator(np.random.PCG64(SEED))
        first, second = ({k: np.zeros_like(v) for k, v in net.params.items()} for _ in range(2))
        steps, seen, waiting = 0, 0, None

        def step(windows) -> None:
            nonlocal steps
            steps += 1
            g = net.gradient(*windows)
            for k, p in net.params.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                p -= RATE * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-6)

        for batch in batches:
            for part in slices(batch, "text"):
                s = Stream(part.column("text"), subwords)
                s.expand()
                found = _windows(model.slot[s.ids], s.ptr, end)
                order = random.permutation(len(found[0]))
                seen += len(order)
                found = [x[order] if waiting is None else np.concatenate([w, x[order]]) for x, w in zip(found, waiting or found, strict=True)]
                full = len(found[0]) // BATCH * BATCH
                for a in range(0, full, BATCH):
                    step([x[a : a + BATCH] for x in found])
                waiting = [x[full:] for x in found]
        if waiting is not None and len(waiting[0]):
            step(waiting)
        if seen:
            flat = np.concatenate([net.params[k].reshape(-1) for k in sorted(net.params)]).astype(np.float64) * seen
            parts = [flat[a : a + CHUNK] for a in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], ["chunk", "seen", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by chunk of what one task reads; its size is the model's."""
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for c, n, v in zip(batch.column("chunk").to_pylist(), batch.column("seen").to_pylist(), batch.column("sums"), strict=True):
            v = v.values.to_numpy()
            sums[c], seen[c] = sums[c] + v if c in sums else v.copy(), seen.get(c, 0) + n
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(seen.values()), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["chunk", "seen", "sums"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent, counts, total = shared.value
        subwords, net = Subwords(model.vocabulary), Attention(model.log_pairs, model.params)
        end = int(model.slot[model.end])
        logs = np.log10((counts + 0.1) / total)
        for batch in batches:
            for part in slices(batch, "text"):
                s = Stream(part.column("text"), subwords)
                s.expand()
                slots = model.slot[s.ids]
                row = np.repeat(np.arange(s.rows), np.diff(s.ptr))
                score = np.bincount(row, net.logs(slots, row, end) + model.log_rest[s.ids], s.rows) / np.log(10)
                at = np.minimum(np.searchsorted(frequent, s.used), max(0, len(frequent) - 1))
                found = frequent[at] == s.used if len(frequent) else np.zeros(len(s.used), bool)
                words = np.diff(s.word_ptr)
                owner = np.repeat(np.arange(s.rows), words)
                hit = found[s.inverse]
                base = np.bincount(owner[hit], logs[at[s.inverse[hit]]], s.rows) if len(frequent) else np.zeros(s.rows)
                known = np.bincount(owner[hit], minlength=s.rows)
                # The other words: once a row, with how often.
                pair, n = np.unique((owner[~hit].astype(np.int64) << 32) + s.inverse[~hit], return_counts=True)
                ptr = np.searchsorted(pair >> 32, np.arange(s.rows + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ptr), pa.StructArray.from_arrays([pa.array(s.used.view(np.int64)[pair & 0xFFFFFFFF]), pa.array(n.astype(np.int64))], ["key", "times"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array((words + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), rare], ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"])

    return run


def _counted(docs: DataFrame, vocabulary: bytes) -> tuple[DataFrame, DataFrame]:
    """Word counts and id-pair counts of the training documents."""
    rows = docs.filter(~held_out(F.col("doc_id"))).select("text").mapInArrow(_count(vocabulary), "kind int, key long, n long")
    counts = written(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    return counts.filter("kind = 0").select("key", "n"), counts.filter("kind = 1").select("key", "n")


def fitted(docs: DataFrame, pairs: DataFrame, vocabulary: bytes) -> SimpleNamespace:
    """The model, with weights averaged over the tasks' training."""
    spark = docs.sparkSession
    end = max(int(x.split()[1]) for x in vocabulary.splitlines()) + 1
    single = pairs.groupBy((F.col("key") % (1 << 20)).alias("id")).agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    id_counts = np.zeros(end + 1)
    id_counts[single["id"].to_numpy()] = single["n"].to_numpy()
    # Pairs of ids with a slot, the others as one id: at most SLOTS**2 rows.
    order = np.argsort(-id_counts, kind="stable")
    own = {int(i) for i in order[order != end][: SLOTS - 2]} | {end}
    other = next(i for i in range(end, -1, -1) if i not in own)
    named = spark.createDataFrame([(i,) for i in sorted(own)], "slot_id long")
    before, after = F.shiftright("key", 20), F.col("key") % (1 << 20)
    folded = pairs.select(before.alias("a"), after.alias("b"), "n").join(F.broadcast(named), F.col("a") == F.col("slot_id"), "left").withColumn("a", F.coalesce("slot_id", F.lit(other))).drop("slot_id")
    folded = folded.join(F.broadcast(named), F.col("b") == F.col("slot_id"), "left").withColumn("b", F.coalesce("slot_id", F.lit(other))).drop("slot_id")
    table = folded.groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    model = new_model(vocabulary, end, id_counts, np.stack([table[c].to_numpy() for c in ("a", "b", "n")], 1))
    rows = docs.filter(~held_out(F.col("doc_id"))).select("text", F.xxhash64("doc_id", "text").alias("hash"))  # copies of a text go to several tasks
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    for turn in range(ROUNDS):
        _round(rows.filter(F.pmod("hash", F.lit(ROUNDS)) == turn), model, chars // (ROUNDS * TASK_CHARS) + 1)
    return model


def _round(rows: DataFrame, model: SimpleNamespace, tasks: int) -> None:
    """Trains the model's weights on rows (text, hash) in so many tasks and averages them, by windows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    dealt = rows.repartition(tasks, F.shiftright("hash", 8)).sortWithinPartitions("hash", "text").select("text")
    schema = "chunk int, seen long, sums array<double>"
    sums = dealt.mapInArrow(_train(shared), schema).repartition(32, "chunk").mapInArrow(_add, schema).toArrow()  # one row a chunk of the weights
    if sums.num_rows:
        parts = sorted(zip(sums["chunk"].to_pylist(), sums["seen"].to_pylist(), sums["sums"].to_pylist(), strict=True))
        flat, at = np.concatenate([np.array(v) / n for _, n, v in parts]).astype(np.float32), 0
        for k in sorted(model.params):
            shape = model.params[k].shape
            model.params[k] = flat[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
    shared.destroy()


def score(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    tokenizer: a public byte-level vocabulary in rank format, read by the driver and sent to the tasks."""
    with open(tokenizer, "rb") as file:
        vocabulary = file.read()
    spark = docs.sparkSession
    words, pairs = _counted(docs, vocabulary)
    model = fitted(docs, pairs, vocabulary)
    n_all, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = n_all + 0.1 * (distinct + 1)
    # Frequent words: the counts' powers of two (at most 63 rows) show from which on they are few enough.
    steps = sorted((r["p"], r["count"]) for r in words.groupBy(F.floor(F.log2("n")).alias("p")).count().collect())[::-1]
    taken, least = 0, None
    for p, n in steps:
        if taken + n > FREQUENT:
            break
        taken, least = taken + n, p
    top = words.filter(F.lit(False) if least is None else F.col("n") >= 2**least).toArrow()
    key, n = top["key"].to_numpy().view(U), top["n"].to_numpy().astype(float)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((model, key[order], n[order], total))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = cut(rows.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<key:long,times:long>>").withColumn("row", F.monotonically_increasing_id()))
    end = words.filter(F.col("key") == int(np.array([_END_WORD]).view(np.int64)[0])).first()
    n_end = end["n"] if end else 0
    weight = lambda n: F.log10((n + 0.1) / F.lit(float(total)))
    rare = scored.select("row", F.explode("rare").alias("w")).select("row", "w.key", "w.times")
    count = F.coalesce("n", F.lit(0))
    more = rare.join(words.hint("merge"), "key", "left").groupBy(F.col("row").alias("r_row")).agg(F.sum(F.col("times") * weight(count)).alias("r_base"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("r_known"))
    out = scored.drop("rare").join(more, F.col("row") == F.col("r_row"), "left")
    base = F.col("base") + F.coalesce("r_base", F.lit(0.0)) + weight(F.lit(float(n_end)))
    known = (F.col("known") + F.coalesce("r_known", F.lit(0)) + int(n_end > 0)).cast("long")
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
