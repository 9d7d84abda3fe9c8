"""Whitening of embeddings by the leading eigenvectors of their covariance, without forming it.

Block Lanczos: each pass over the vectors applies the centred covariance to a block of at most BLOCK directions,
as tasks add up X'(Xv) over their rows and Spark adds up the tasks' sums. The image of a block, made orthogonal twice
against the whole basis, is the next block. A direction that has nothing new in it (breakdown) is replaced by a random one
that is orthogonal to all before, so equal eigenvalues and invariant subspaces end nothing early. When the basis would
pass BASIS columns, it restarts from its best Ritz vectors, whose images are known. It ends when the residuals of the
wanted pairs are at the noise of double numbers and a further random block has changed none, or when the basis is the whole space.

Entries become whole numbers (SCALE, SHIFT), so sums are exact; rows are centred before they are multiplied. The trace is
the sum of the rows' squared deviations, so shares of it need no other eigenvalue.

Edge cases: a vector that is null or has a null or non-finite entry is dropped; so is one that hasn't the commonest length (at a
tie the longest), an empty one included; repeated rows count each time; a null vec_id stays; components whose
variance is only rounding noise don't exist (all vectors equal: no component, an empty result); a deviation
over 2**63 is null; entries beyond 2**40 count as 2**40. Columns other than vec_id and embedding are ignored by query()
and kept by transform().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Directions of one pass, and columns of the basis at most (never more than the dimensions).
BLOCK, BASIS = 16, 256
#: A residual below this share of the largest eigenvalue is noise, and so is a new direction or an eigenvalue.
NOISE = 1e-14
SEED = 12
#: Numbers that a task centres at once.
PART = 1 << 20


def fixed(vector: Column) -> Column:
    """The entries as whole numbers."""
    far = F.lit(2.0**40)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double"), far), -far) * SCALE) + SHIFT)


def cleaned(rows: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that count, their entries as the array _cf_x beside all columns, and the number of dimensions (0 without rows)."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    good = rows.filter(F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)))
    common = good.filter(F.size(column) > 0).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    return good.filter(F.size(column) == d).select(F.struct(*rows.columns).alias("_cf_row"), fixed(F.col(column)).alias("_cf_x")), d


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches and their entries, a row each."""
    for batch in batches:
        step = max(1, PART // d)
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, part.column("_cf_x").flatten().to_numpy().reshape(-1, d)


def _added(rows: DataFrame, d: int, shape: tuple[int, ...], add: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray:
    """The sum of add(entries) over all rows. Every task hands on one sum of this fixed shape, and Spark adds those up."""
    kind, name = (np.int64, "long") if whole else (np.float64, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _parts(batches, d):
            found = add(x)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1).astype(kind))], ["place", "value"])

    out = np.zeros(int(np.prod(shape)), kind)
    for r in rows.select("_cf_x").mapInArrow(run, f"place int, value {name}").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out.reshape(shape)


def _off(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as Python's numbers where 64 bits are too few."""
    if int(np.abs(x).max(initial=0)) * n >= 2**62:
        return n * x.astype(object) - sums.astype(object)
    return n * x - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _off(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum of (n * x - S)**2 of each row, exact."""
    off = _off(x, n, sums)
    if off.dtype == object or int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] >= 2**63:
        return (off.astype(object) ** 2).sum(1)
    return (off * off).sum(1)


def orthogonal(new: np.ndarray, basis: np.ndarray, least: float, random: np.random.Generator) -> np.ndarray:
    """Unit directions for the columns of new, orthogonal to the basis and each other; one shorter than least is replaced at random."""
    out = basis
    for column in new.T[: new.shape[0] - basis.shape[1]]:
        v = column
        for _ in range(9):
            for _ in range(2):
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > least:
                break
            v, least = random.standard_normal(len(v)), 1e-3
        v = v / size
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, most: int = BASIS, passes: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric operator, falling, and their unit eigenvectors as columns."""
    random = np.random.Generator(np.random.PCG64(SEED))
    wanted, most = min(wanted, d), min(d, max(most, 2 * (wanted + block)))
    empty = np.empty((d, 0))
    basis, image = empty, empty
    new, before, checked = orthogonal(random.standard_normal((d, min(block, d))), empty, 0.0, random), None, False
    for _ in range(passes):
        basis, image = np.column_stack([basis, new]), np.column_stack([image, apply(new)])
        ritz = basis.T @ image
        values, inner = np.linalg.eigh((ritz + ritz.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        size = max(values[0], 0.0)
        vectors = basis @ inner
        residual = image @ inner - vectors * values
        if basis.shape[1] == d:
            break
        norms = np.linalg.norm(residual[:, :wanted], axis=0)
        settled = len(norms) == wanted and bool((norms <= NOISE * np.sqrt(d) * size).all())
        same = before is not None and settled and bool(np.allclose(values[:wanted], before, rtol=1e-12, atol=NOISE * d * size))
        if checked and same:
            break
        before = values[:wanted].copy() if settled else None
        if basis.shape[1] + block > most:
            # Restart: the best Ritz vectors and their images span what has been learned.
            keep = min(wanted + block, basis.shape[1] - block)
            basis, image = vectors[:, :keep], image @ inner[:, :keep]
            basis, mix = np.linalg.qr(basis)
            image = np.linalg.solve(mix.T, image.T).T
        # The residuals of the pairs that are furthest from settled span the next Krylov block.
        order = np.argsort(-np.linalg.norm(residual[:, : max(wanted, block)], axis=0), kind="stable")[:block]
        ahead = random.standard_normal((d, block)) if settled else residual[:, order]
        checked = settled
        new = orthogonal(ahead, basis, NOISE * max(size, 1e-300), random)
    vectors = vectors[:, :wanted]
    return values[:wanted], vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def shares(self) -> np.ndarray:
        return self.values / self.trace

    def of(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)


def _fit(rows: DataFrame, d: int, components: int) -> Whitening | None:
    if not d:
        return None
    first = _added(rows, d, (d + 1,), lambda x: np.concatenate([x.sum(0), [len(x)]]), whole=True)
    sums, n = first[:-1], int(first[-1])

    def apply(v: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ v)

        return _added(rows, d, v.shape, add) / n

    values, vectors = lanczos(apply, d, components)
    real = values > NOISE * d * max(values[0], 0.0)
    model = Whitening(n, sums, values[real], vectors[:, real], 0.0, 0.0)
    k = int(real.sum())
    if not k:
        return None

    def add(x: np.ndarray) -> np.ndarray:
        w = model.of(x)
        return np.concatenate([(w.T @ w).reshape(-1), w.sum(0), [float(deviations(x, n, sums).sum())]])

    total = _added(rows, d, (k * k + k + 1,), add)
    mean = total[k * k : -1] / n
    model.trace = total[-1] / n**3
    model.identity_error = float(np.abs(total[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def fit(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Mean, eigenvectors and eigenvalues of a table's vectors; None if they don't vary."""
    return _fit(*cleaned(table, column), components)


def _transform(rows: DataFrame, d: int, model: Whitening, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for part, x in _parts(batches, d):
            off = [v if v < 2**63 else None for v in deviations(x, model.n, model.sums).tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(model.of(x).reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("_cf_row"), pa.array(off, pa.int64()), lists], ["_cf_row", "deviation", "whitened"])

    schema = rows.select("_cf_row").schema.add("deviation", "long").add("whitened", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, schema).select(*(F.col("_cf_row")[c].alias(c) for c in columns), "deviation", "whitened")


def transform(table: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The rows that count, with their deviation and whitened vector (in place of columns of these names)."""
    rows, d = cleaned(table, column)
    return _transform(rows, d, model, [c for c in table.columns if c not in ("deviation", "whitened")])


def query(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    rows, d = cleaned(table.select("vec_id", column), column)
    model = _fit(rows, d, components)
    if not model:
        return table.sparkSession.createDataFrame([], f"vec_id {dict(table.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = _transform(rows, d, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    share = F.get(F.array(*(F.lit(float(v)) for v in model.shares)), F.col("place"))
    return found.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
