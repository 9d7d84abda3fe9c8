"""Near-duplicate documents by a signature-coordinate inverted join.

Each distinct shingle set has a minhash signature of ``coordinates`` values. Two sets at the similarity
threshold agree on about that share of coordinates, and on ``matches`` of them at least with a miss rate
below one in 100,000 (see misses()). Every set is posted under its coordinate-value pairs; as in prefix
and skip merging for occurrence thresholds, a pair of sets with ``matches`` agreements must meet in the
``coordinates - matches + 1`` rarest pairs of each, so only those postings are joined, and the frequent
lists are skipped: their agreements are counted on the signatures of the pairs that met. Links are
confirmed on the full sets.

Equal sets are one node from the start. A list of at most SMALL + 1 sets gives all its pairs. A longer one
gives stars only: each member with one centre, the set whose coordinate values are shared most (the text
that copies were made from). A link between two members that belong to different components after that
is found from what each adds to a centre's set and lacks of it. (Centres that resemble a centre of larger
lists give way to that one, so that all copies of a text are held against the same set.)

* The centre's set is first made that of the majority: what more than half of its members add joins it,
  what more than half lack leaves it. So members differ from it in their own ways.
* Members that have little in common with the centre, as those of a value that many texts have by chance, would differ from it in whole
  sets. They are held against each other by their signatures, in blocks (see far()).
* Two linked members, one of which isn't in the centre's component, must add or lack in common a number of
  shingles that follows from their sizes. Differences are posted under the centre, as many as a linked set
  needs at most, and joined like a prefix of a set, with the positions' bound (see apart()).
* Before that each member is held against the one nearest to the majority's set, and members of very long
  lists of differences against one of theirs, so that copies of a copy are one component by then.

So groups of copies give stars, not all pairs, and no link between different components is lost but by the
miss rate. What is left are pairs of sets that share differences and aren't linked.

Edge cases: null or empty text, or text without words, has an empty set and is linked with nothing;
fewer words than a shingle make one shingle of them all; repeated rows are equal sets; the component of
rows without any doc_id is null; an empty table gives an empty result. Columns other than doc_id and
text are ignored by link() and kept by deduped(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, shared_path, written
from .components import components
from .kernels import U, MinHash, Words, document_set, mixed, set_name, slices

COORDINATES, MATCHES, SEED = 48, 25, 8
SHINGLE, THRESHOLD = 2, 80
SMALL = 8
#: A centre that agrees on so many coordinates with the centre of a list that it is in gives way to that one.
FAMILY = 12
#: A member that agrees with a centre on fewer coordinates than APART is no member by its differences; members of lists that agree on fewer than
#: HALF are held against each other. Linked sets are both among one of these, see straddles().
APART, HALF = 10, 24
#: Members that are held against each other in blocks.
MANY = 2048
#: A difference with a centre that so many sets outside the commonest component have gives stars first.
LONG = 100
#: Shingles of differences that a task holds before it hands them on.
PART = 1 << 19
#: Bits of the table that tells which documents' sets are needed.
TABLE_BITS = 23
#: The lowest bit of each byte of a long.
_ONES = 0x0101010101010101


def misses(coordinates: int = COORDINATES, matches: int = MATCHES, similarity: float = THRESHOLD / 100) -> float:
    """The chance that two sets of this similarity agree on fewer than matches coordinates."""
    return sum(math.comb(coordinates, i) * similarity**i * (1 - similarity) ** (coordinates - i) for i in range(matches))


def straddles(similarity: float = THRESHOLD / 100) -> float:
    """The chance, at most, that of two sets of this similarity one agrees with a third on HALF coordinates and the other one on fewer than APART."""
    return sum(math.comb(HALF, i) * (1 - similarity) ** i * similarity ** (HALF - i) for i in range(HALF - APART + 1, HALF + 1))


def _sign(k: int, coordinates: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(coordinates, seed)
        salt = mixed(np.arange(1, coordinates + 1, dtype=U))
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                sets = [document_set(words.hash[a:b], k) for a, b in zip(words.ptr, words.ptr[1:], strict=False)]
                sizes = np.array([len(x) for x in sets])
                full = np.flatnonzero(sizes)
                keys = np.empty((0, coordinates), U)
                if len(full):
                    keys = mixed(minhash.of(np.concatenate([sets[i] for i in full]), np.cumsum(sizes[full]) - sizes[full]) ^ salt)
                at = np.cumsum(sizes > 0) * coordinates
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at]).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                names = pa.array([set_name(x) if len(x) else None for x in sets], pa.binary())
                more = part.schema.names[2:]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes.astype(np.int64)), names, lists, *map(part.column, more)], ["doc_id", "n_shingles", "name", "keys", *more])

    return run


def marks(keys: Column, coordinates: int) -> Column:
    """A signature with one byte a coordinate, as longs: to count agreements of pairs, an eighth of its size."""
    byte = lambda i: F.shiftleft(keys[i].bitwiseAND(F.lit(255)), i % 8 * 8) if i < coordinates else F.lit(0).cast("long")
    return F.array(*(reduce(lambda x, y: x.bitwiseOR(y), [byte(i) for i in range(a, a + 8)]) for a in range(0, coordinates, 8)))


def agreements(x: Column, y: Column, coordinates: int) -> Column:
    """On how many coordinates two signatures agree by their marks: no fewer than by their keys, and one in 256 of the others."""

    def differ(i: int) -> Column:
        bits = x[i].bitwiseXOR(y[i])
        for n in (4, 2, 1):  # the lowest bit of a byte tells whether any of it is set
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, n))
        return F.bit_count(bits.bitwiseAND(F.lit(_ONES)))

    return F.lit(coordinates) - reduce(lambda a, b: a + b, [differ(i) for i in range(-(-coordinates // 8))])


def signed(docs: DataFrame, k: int = SHINGLE, coordinates: int = COORDINATES, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, name of the set (null if empty), and the signature as coordinate-value hashes;
    and the text's hash _cf_hash if docs has it."""
    kind = dict(docs.dtypes)["doc_id"]
    more = [c for c in docs.columns if c == "_cf_hash"]
    return docs.select("doc_id", "text", *more).mapInArrow(_sign(k, coordinates, seed), f"doc_id {kind}, n_shingles long, name binary, keys array<long>" + "".join(f", {c} long" for c in more))


def _sets(k: int, bits: np.ndarray):
    """name and items of the sets of documents whose place in the bit table is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            wanted = (bits[place >> 6] >> (place & 63).astype(U)) & U(1)
            for part in slices(batch.filter(pa.array(wanted.astype(bool))), "text"):
                words = Words(part.column("text"))
                items = [document_set(words.hash[a:b], k) for a, b in zip(words.ptr, words.ptr[1:], strict=False)]
                names = [set_name(x) if len(x) else None for x in items]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([x.tobytes() for x in items], pa.binary())], ["name", "items"])

    return run


def _profile(threshold: int, star: bool):
    """Of each pair of sets (a, b): e and r, the numbers of shingles that a adds to b and lacks of it, m, the size
    of b, and excess, by how much they miss a link, in units of 1 / (100 + threshold) shingles; and with star
    the shingles added and lacking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, added, lacking, size, start = [], [], [], 0, 0
            for i, (x, y) in enumerate(zip(batch.column("a_items"), batch.column("b_items"), strict=True)):
                a, b = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                has = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
                both = int(np.count_nonzero(has))
                e, r = len(a) - both, len(b) - both
                counts.append((e, r, len(b), 100 * r + threshold * e - (100 - threshold) * len(b)))
                added.append(a[~has].view(np.int64) if star else None)
                lacking.append(b[a[np.minimum(np.searchsorted(a, b), len(a) - 1)] != b].view(np.int64) if star else None)
                size += star * (e + r)
                if size > PART or i == batch.num_rows - 1:
                    names = ("e", "r", "m", "excess")
                    numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(names))]
                    lists = [pa.array(v, pa.list_(pa.int64())) for v in (added, lacking)]
                    yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, len(counts)) for c in ("a", "b")] + numbers + lists, ["a", "b", *names, "added", "lacking"])
                    counts, added, lacking, size, start = [], [], [], 0, i + 1

    return run


def _held(threshold: int, matches: int, coordinates: int):
    """Pairs (a, b) of members of one list in two blocks, of different labels, of which one is lone (not sought by its differences), at least, that may be linked."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = (v.as_py() for v in key[1:])
        block = rows.column("block").to_numpy()
        sides, out = [], []
        for v in (low, high):
            side = rows.filter(pa.array(block == v))
            marked = side.column("marks").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(side.num_rows, -(-coordinates // 8) * 8)
            sides.append((*(side.column(c).to_numpy() for c in ("a", "label", "n", "lone")), marked))
        (x, x_label, x_n, x_lone, x_marks), (y, y_label, y_n, y_lone, y_marks) = sides
        for first in range(0, len(x), 128):
            of = slice(first, first + 128)
            asked = (x[of, None] < y if low == high else x[of, None] != y) & (x_label[of, None] != y_label)
            asked &= (x_lone[of, None] | y_lone) & (100 * np.minimum(x_n[of, None], y_n) >= threshold * np.maximum(x_n[of, None], y_n))
            i, j = np.nonzero(asked)
            differ = np.zeros(len(i), np.uint8)
            for c in range(coordinates):
                differ += x_marks[of, c][i] != y_marks[:, c][j]
            met = coordinates - differ.astype(np.int64) >= matches
            out.append((x[of][i[met]], y[j[met]]))
        a, b = (np.concatenate([o[n] for o in out]) if out else np.empty(0, np.int64) for n in (0, 1))
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


class _Graph:
    """The distinct sets, their prefix postings, and the test of a pair."""

    def __init__(self, docs: DataFrame, k: int, threshold: int, coordinates: int, matches: int, seed: int):
        self.texts, self.k, self.threshold, self.matches, self.coordinates = docs.select("doc_id", "text"), k, threshold, matches, coordinates
        signed(docs, k, coordinates, seed).write.parquet(sets := shared_path(docs.sparkSession, "sets"))
        every = docs.sparkSession.read.parquet(sets)
        distinct = every.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys"))
        # The numbers are fixed once written.
        distinct.select("name", "first_id", "n", "keys", marks(F.col("keys"), coordinates).alias("marks"), F.monotonically_increasing_id().alias("node")).write.parquet(signatures := shared_path(docs.sparkSession, "signatures"))
        self.docs = written(every.drop("keys"), "documents")
        removed(docs.sparkSession, sets)
        numbered = docs.sparkSession.read.parquet(signatures)
        self.nodes = written(numbered.drop("keys"), "nodes")
        postings = numbered.select("node", F.explode("keys").alias("key"))
        # Written first, so that the join can split a value that many sets share.
        often = written(postings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "often")
        shared = postings.join(often.hint("merge"), "key")
        # A pair that no other set has is rarest of all: it takes a place in the prefix but joins nothing.
        mine = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("s"), F.sum("c").alias("weight"))
        places = coordinates - matches + 1 - (coordinates - F.size("s"))
        prefix = mine.filter(places > 0).select("node", "weight", F.explode(F.slice("s", F.lit(1), F.greatest(places, F.lit(1)))).alias("p"))
        self.posted_keys = written(prefix.select(F.col("p.key").alias("key"), "node", F.col("weight").alias("rank")), "posted")
        removed(docs.sparkSession, signatures)

    def sets(self, ids: DataFrame) -> DataFrame:
        """name and items of the sets of the documents ids (column id), and of a few others.

        The ids are told apart by a table of 2**TABLE_BITS bits (2 MB at most), so that no text is
        shuffled; when more and more ids fill the table, more sets than needed are made, no fewer."""
        place = F.pmod(F.xxhash64("id"), F.lit(1 << TABLE_BITS))
        word = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b")).toArrow()
        bits = np.zeros(1 << (TABLE_BITS - 6), np.int64)
        bits[word["w"].to_numpy()] = word["b"].to_numpy()
        texts = self.texts.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << TABLE_BITS)).alias("place"), "text")
        return texts.mapInArrow(_sets(self.k, bits.view(U)), "name binary, items binary")

    def agreed(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, ...) with the number of coordinates on which they agree, and whether they may be linked (met)."""
        side = lambda p: self.nodes.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), F.col("marks").alias(f"{p}_marks"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("agree", agreements(F.col("a_marks"), F.col("b_marks"), self.coordinates))
        small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
        return sized.withColumn("met", (100 * small >= self.threshold * large) & (F.col("agree") >= self.matches)).select(*pairs.columns, "agree", "met")

    def compared(self, pairs: DataFrame, star: bool = False) -> DataFrame:
        """Full sets of pairs (a, b) held against each other; with star, of members a and centres b. See _profile()."""
        side = lambda p: self.nodes.select(F.col("node").alias(p), F.col("name").alias(f"{p}_name"), F.col("first_id").alias(f"{p}_id"))
        named = written(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b"), "asked")
        items = lambda p: self.sets(named.select(F.col(f"{p}_id").alias("id"))).select(F.col("name").alias(f"{p}_name"), F.col("items").alias(f"{p}_items")).hint("merge")
        first = named.select("a", "b", "a_name", "b_name").join(items("a"), "a_name").select("a", "b", "b_name", "a_items")
        both = first.join(items("b"), "b_name").select("a", "b", "a_items", "b_items")
        return written(both.mapInArrow(_profile(self.threshold, star), "a long, b long, e long, r long, m long, excess long, added array<long>, lacking array<long>").dropDuplicates(["a", "b"]), "compared")

    def lists(self) -> tuple[DataFrame, DataFrame]:
        """The pairs (a, b) of small lists; and the rows (key, a, b, rank) of longer ones with their centres b."""
        posted = self.posted_keys
        lists = posted.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("rank", "node")).alias("centre")).filter("n > 1")
        tagged = written(posted.select("key", "node").join(written(lists, "lists").hint("merge"), "key"), "tagged")
        few = tagged.filter(F.col("n") <= SMALL + 1).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("v"))
        after = lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.struct(x.alias("a"), y.alias("b")))
        pairs = few.select(F.explode(F.flatten(F.transform("v", after))).alias("p")).select("p.a", "p.b").distinct()
        return pairs, tagged.filter(F.col("n") > SMALL + 1).select("key", F.col("node").alias("a"), F.col("centre.node").alias("b"), F.col("centre.rank").alias("rank"))

    @staticmethod
    def roots(stars: DataFrame) -> DataFrame:
        """centre and root: for centres that resemble centres of higher rank, the last one of that chain."""
        centres = stars.select(F.col("b").alias("centre")).distinct()
        up = stars.filter(F.col("agree") >= FAMILY).join(centres, F.col("a") == F.col("centre"), "left_semi")
        found = written(up.groupBy(F.col("a").alias("centre")).agg(F.max(F.struct("rank", "b"))["b"].alias("root")), "roots")
        while True:  # ranks rise, so that there is no circle
            above = found.select(F.col("centre").alias("next"), F.col("root").alias("above"))
            found = written(found.join(above, F.col("root") == F.col("next"), "left").select("centre", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
            if found.filter("moved").isEmpty():
                return found.select("centre", "root")
            found = found.select("centre", "root")

    def open_stars(self, lists: DataFrame, roots: DataFrame, labels: DataFrame) -> DataFrame:
        """Members a and centres b of the lists that have several labels."""
        marked = lists.join(labels, F.col("a") == F.col("node"), "left").withColumn("label", F.coalesce("label", "a"))
        mixed_up = written(marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key"), "open")
        rows = lists.join(mixed_up, "key").join(roots, F.col("b") == F.col("centre"), "left")
        return rows.select("a", F.coalesce("root", "b").alias("b")).filter("a <> b").distinct()

    def far(self, stars: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of one centre of the stars, of different labels, that may be linked and of which one, at least, isn't sought by its differences. The members are dealt into blocks, and every two blocks
        are held against each other in one group, by their marks: what is shuffled grows with the members and not with their sets."""
        rows = stars.select(F.col("b").alias("centre"), F.col("a").alias("node"), (F.col("agree") < APART).alias("lone")).join(self.nodes.select("node", "n", "marks"), "node").join(labels, "node", "left").select("centre", F.col("node").alias("a"), F.coalesce("label", "node").alias("label"), "n", "lone", "marks")
        parts = written(stars.groupBy(F.col("b").alias("p_centre")).agg(F.ceil(F.count("*") / MANY).cast("int").alias("parts")), "parts")
        dealt = rows.join(parts, F.col("centre") == F.col("p_centre")).withColumn("block", F.pmod(F.xxhash64("a"), "parts").cast("int"))
        copied = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        return copied.select("centre", "low", "high", "block", "a", "label", "n", "lone", "marks").groupBy("centre", "low", "high").applyInArrow(_held(self.threshold, self.matches, self.coordinates), "a long, b long").distinct()

    def members(self, profile: DataFrame, labels: DataFrame) -> DataFrame:
        """The profile with the label of a, whether b's differs (other), and the least excess of any such member
        of b (low); of centres with such members only."""
        label = lambda p: labels.select(F.col("node").alias(f"{p}_node"), F.col("label").alias(f"{p}_label"))
        marked = profile.join(label("a"), F.col("a") == F.col("a_node"), "left").join(label("b"), F.col("b") == F.col("b_node"), "left")
        marked = written(marked.withColumn("label", F.coalesce("a_label", "a")).withColumn("other", F.col("label") != F.coalesce("b_label", "b")).drop("a_node", "a_label", "b_node", "b_label"), "marked")
        mixed_up = marked.filter("other").groupBy(F.col("b").alias("open")).agg(F.min("excess").alias("low"))
        return marked.join(written(mixed_up, "open"), F.col("b") == F.col("open")).drop("open")

    def majority(self, members: DataFrame) -> DataFrame:
        """Members' profiles with their centre's set made that of the majority."""
        token = lambda c: members.select("b", F.explode(c).alias("token"), F.lit(c).alias("kind"))
        size = members.groupBy("b").agg(F.count("*").alias("n"))
        often = token("added").unionByName(token("lacking")).groupBy("b", "kind", "token").agg(F.count("*").alias("c")).filter("c > 1")
        # At most twice as many for a centre as its members differ from it on average.
        turned = often.join(size, "b").filter("2 * c > n").groupBy("b").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("token"))).alias(f"turned_{k}") for k in ("added", "lacking")))
        rows = members.select("a", "b", "m", "added", "lacking").join(written(turned, "turned"), "b", "left")
        none = F.array().cast("array<long>")
        t_added, t_lacking = (F.coalesce(f"turned_{k}", none) for k in ("added", "lacking"))
        rows = rows.select("a", "b", (F.col("m") + F.size(t_added) - F.size(t_lacking)).alias("m"), F.array_union(F.array_except("added", t_added), F.array_except(t_lacking, "lacking")).alias("added"), F.array_union(F.array_except("lacking", t_lacking), F.array_except(t_added, "added")).alias("lacking"))
        rows = written(rows.select("a", "b", "m", "added", "lacking", F.size("added").cast("long").alias("e"), F.size("lacking").cast("long").alias("r")), "turned")
        rows = self.rarest_first(rows).withColumn("excess", 100 * F.col("r") + self.threshold * F.col("e") - (100 - self.threshold) * F.col("m"))
        return written(rows, "majority")

    @staticmethod
    def rarest_first(members: DataFrame) -> DataFrame:
        """members with their differences in an order that all members of a centre share, rarest first: so the first ones, which
        are posted, are had by few."""
        kinds = ("added", "lacking")
        tokens = reduce(DataFrame.unionByName, [members.select("b", "a", F.lit(i).alias("kind"), F.explode(c).alias("token")) for i, c in enumerate(kinds)])
        often = written(tokens.groupBy("b", "kind", "token").agg(F.count("*").alias("c")).filter("c > 1"), "tokens")
        ordered = tokens.join(often.hint("merge"), ["b", "kind", "token"], "left").groupBy(F.col("b").alias("t_b"), F.col("a").alias("t_a")).agg(F.sort_array(F.collect_list(F.struct("kind", F.coalesce("c", F.lit(1)).alias("c"), "token"))).alias("t"))
        of = lambda i: F.coalesce(F.transform(F.filter("t", lambda v: v["kind"] == i), lambda v: v["token"]), F.array().cast("array<long>"))
        return members.drop(*kinds).join(ordered, (F.col("b") == F.col("t_b")) & (F.col("a") == F.col("t_a")), "left").select("a", "b", "m", "e", "r", *(of(i).alias(c) for i, c in enumerate(kinds)))

    @staticmethod
    def nearest(members: DataFrame) -> DataFrame:
        """Pairs (a, b) of each member and that which differs least from the majority's set, where labels differ."""
        best = written(members.groupBy("b").agg(F.min(F.struct((F.col("e") + F.col("r")).alias("far"), "a", "label")).alias("best")), "best")
        rows = members.select("b", "a", "label").join(best, "b").filter(F.col("label") != F.col("best.label"))
        return rows.select(F.least("a", "best.a").alias("a"), F.greatest("a", "best.a").alias("b")).distinct()

    def posted(self, members: DataFrame) -> DataFrame:
        """The first differences of members as (b, token, at): added ones before lacking ones, and as many as
        are to be posted as x (as_x) and as y (as_y) of apart()."""
        t = self.threshold
        e, r, m, d = (F.col(c) for c in ("e", "r", "m", "d"))
        slack = F.floor((m - r + e) * (100 - t) / 100)  # linked sets have so many shingles each that the other lacks at most
        limit = F.when(e > slack, slack + 1).otherwise(d)
        least = lambda needed: F.greatest(F.lit(0), F.least(limit, d + 1 - F.greatest(F.lit(1), F.ceil(needed / (100 + t))))).cast("int")
        as_x, as_y = least(F.col("excess") + t), least(F.least(F.lit(1), F.col("low")) + 100 * r + t * e)
        rows = members.withColumn("d", e + r).withColumns({"as_x": F.when(F.col("other"), as_x).otherwise(0), "as_y": as_y})
        first = F.slice(F.concat("added", "lacking"), F.lit(1), F.greatest("as_x", "as_y"))
        return rows.select("b", F.posexplode(first).alias("at", "token"), "a", "e", "r", "m", "excess", "as_x", "as_y", "label", "other")

    def long_lists(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b) of each member of a long list of differences and the one of them that differs least, where labels differ."""
        posted = self.posted(members).select("b", "token", "a", "label", (F.col("e") + F.col("r")).alias("far"))
        by_label = posted.groupBy("b", "token", "label").agg(F.count("*").alias("n"), F.min(F.struct("far", "a", "label")).alias("best"))
        lists = by_label.groupBy("b", "token").agg((F.sum("n") - F.max("n")).alias("others"), F.min("best").alias("best")).filter(F.col("others") > LONG)
        stars = posted.join(written(lists, "long"), ["b", "token"]).filter(F.col("label") != F.col("best.label"))
        return stars.select(F.least("a", "best.a").alias("a"), F.greatest("a", "best.a").alias("b")).distinct()

    def apart(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b) of members x and y of one centre c, of different labels, x not of c's, that may be linked.

        With t per cent, x and y are linked if they share t / (100 + t) of |x| + |y|. They share c less what either
        lacks, and what both add. So they are linked if they lack in common and add in common, together, at
        least needed = (excess(x) + 100 r(y) + t e(y)) / (100 + t) shingles. If that is above 0, they share one
        of the first differences of each, as many as leave that number behind, as in a prefix join. (A set
        that adds more than a linked set may lack must share one of the first that it adds.) If it isn't, y is
        nearly c and x at the threshold; these few are paired by that alone."""
        t, posted = self.threshold, self.posted(members)
        needed = F.col("x_excess") + 100 * F.col("y_r") + t * F.col("y_e")
        size = lambda p: F.col(f"{p}_m") - F.col(f"{p}_r") + F.col(f"{p}_e")
        # Where both may be x, one order is enough: what is needed is the same either way.
        once = ~F.col("y_other") | (F.col("x_a") < F.col("y_a"))
        can = once & (F.col("x_label") != F.col("y_label")) & (100 * F.least(size("x"), size("y")) >= t * F.greatest(size("x"), size("y")))
        side = lambda p, *names: [F.col(c).alias(f"{p}_{c}") for c in ("a", "e", "r", "m", "excess", "label", "other", *names)]
        x = posted.filter("at < as_x").select("b", "token", *side("x", "at"))
        y = posted.filter("at < as_y").select("b", "token", *side("y", "at"))
        # What the first shared difference leaves of either kind.
        added = lambda p: F.greatest(F.lit(0), F.col(f"{p}_e") - F.col(f"{p}_at"))
        lacking = lambda p: F.least(F.col(f"{p}_r"), F.col(f"{p}_e") + F.col(f"{p}_r") - F.col(f"{p}_at"))
        left = F.least(added("x"), added("y")) + F.least(lacking("x"), lacking("y"))
        found = x.join(y.hint("merge"), ["b", "token"]).filter(can & (left * (100 + t) >= needed))
        near_x = members.filter("other and excess <= 0").select("b", *side("x"))
        near_y = members.filter(F.col("low") + 100 * F.col("r") + t * F.col("e") <= 0).select("b", *side("y"))
        close = near_x.join(near_y.hint("merge"), "b").filter(can & (needed <= 0))
        pair = (F.least("x_a", "y_a").alias("a"), F.greatest("x_a", "y_a").alias("b"))
        return found.select(*pair).union(close.select(*pair)).distinct()

    def labels(self) -> DataFrame:
        """node and label for every node that is linked."""
        linked = lambda found: found.filter("excess <= 0").select("a", "b")
        pairs, lists = self.lists()
        asked = pairs.withColumn("rank", F.lit(None).cast("long")).unionByName(lists.select("a", "b", "rank").filter("a <> b").distinct())
        agreed = written(self.agreed(asked).filter("met or rank is not null"), "agreed")
        links = linked(self.compared(agreed.filter("met").select("a", "b").distinct()))
        labels = components(links)
        members = written(self.agreed(self.open_stars(lists, self.roots(agreed.filter("rank is not null")), labels)), "members")
        least = APART if straddles(self.threshold / 100) < 1e-5 else 0  # else the differences of all members are sought
        stars = self.compared(members.filter(F.col("agree") >= least), star=True)
        apart = self.compared(self.far(members.filter(F.col("agree") < HALF), labels))
        profile, more = self.majority(stars), linked(stars).unionByName(linked(apart))
        for step in (lambda members: self.nearest(members).union(self.long_lists(members)).distinct(), self.apart, None):
            if not more.isEmpty():
                links = links.unionByName(more)
                labels = components(links)
            if step is None or (members := self.members(profile, labels)).isEmpty():
                break
            more = linked(self.compared(self.agreed(step(members)).filter("met")))
        return labels


def link(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, coordinates: int = COORDINATES, matches: int = MATCHES, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    k: words in a shingle; threshold: per cent of shared shingles from which documents are linked."""
    return _linked(docs, k, threshold, coordinates, matches, seed).select("doc_id", "n_shingles", "component_id", "kept")


def _linked(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, coordinates: int = COORDINATES, matches: int = MATCHES, seed: int = SEED) -> DataFrame:
    """link() with named (the text has words) and, if docs has it, _cf_hash."""
    graph = _Graph(docs, k, threshold, coordinates, matches, seed)
    nodes = graph.nodes.select("name", "node", "first_id").join(graph.labels().withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").withColumn("label", F.coalesce("label", "node"))
    ids = nodes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_name = nodes.join(ids, "label").select(F.col("name").alias("n_name"), "component_id")
    rows = graph.docs.join(by_name, F.col("name") == F.col("n_name"), "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    more = [c for c in graph.docs.columns if c == "_cf_hash"]
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("name").isNotNull().alias("named"), *more)


def deduped(docs: DataFrame, **how) -> DataFrame:
    """docs without the rows that link() doesn't keep; rows are told apart by doc_id and text. Of rows equal
    in both one stays, and of near copies with one doc_id the one with the lowest hash; rows without
    doc_id stay."""
    hashed = docs.select(F.struct(*docs.columns).alias("_cf_row"), "doc_id", "text", F.xxhash64("text").alias("_cf_hash"))
    judged = written(_linked(hashed.select("doc_id", "text", "_cf_hash"), **how).filter("doc_id is not null").groupBy("doc_id", "_cf_hash", "named", "kept").agg(F.count("*").alias("n")), "judged")
    # Kept rows of one doc_id that have words are in one component.
    first = judged.filter("kept and named").groupBy(F.col("doc_id").alias("f_id")).agg(F.min("_cf_hash").alias("f_hash"), F.count("*").alias("texts")).filter("texts > 1")
    later = judged.filter("kept and named").join(first, (F.col("doc_id") == F.col("f_id")) & (F.col("_cf_hash") > F.col("f_hash")), "left_semi")
    gone = judged.filter("not kept").unionByName(later).select("doc_id", "_cf_hash")
    again = judged.filter("n > 1").select("doc_id", "_cf_hash").join(gone, ["doc_id", "_cf_hash"], "left_anti")
    key = lambda df: df.select(F.col("doc_id").alias("g_id"), F.col("_cf_hash").alias("g_hash"))
    same = (F.col("doc_id") == F.col("g_id")) & (F.col("_cf_hash") == F.col("g_hash"))
    again = written(key(again), "again")
    single = hashed.join(written(key(gone).unionByName(again), "gone"), same, "left_anti")
    once = hashed.join(again, same, "left_semi").dropDuplicates(["doc_id", "_cf_hash"])
    return single.unionByName(once).select(*(F.col("_cf_row")[c].alias(c) for c in docs.columns))


#: Exact: every pair of documents that share a shingle, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS g FROM t),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, any_value(n.n)::BIGINT AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id
"""
