"""Embedding whitening: covariances exact to the last digit by products of small limbs, then one eigendecomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, stored, table

#: Bits of a limb and rows of one product: sums of ROWS products of two limbs stay below 2**53.
BITS, ROWS = 16, 1 << 14
OFFSET = 1_000_000


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and x = floor(``scale`` * component) + OFFSET of each row whose vector is whole, finite, and fits a long."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < float(1 << 62))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + OFFSET).alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` = sum of limb * 2**(BITS * place) as float64 matrices; all limbs but the signed last are in [0, 2**BITS)."""
    out = []
    while True:
        if -(1 << (BITS - 1)) <= x.min(initial=0) and x.max(initial=0) < 1 << BITS:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << BITS) - 1)).astype(np.float64))
        x = x >> BITS


def limb_products(batches):
    """mapInArrow: products of the columns (a leading one of ones among them), by the place of the limbs, of a partition.

    Each BLAS product is exact in float64; the sums over batches are longs, sent on before they could overflow.
    """
    held: dict[int, np.ndarray] = {}
    room = 0
    for b in batches:
        whole = matrix(b)
        for s in range(0, len(whole), ROWS):
            x = np.concatenate([np.ones((len(whole[s : s + ROWS]), 1), np.int64), whole[s : s + ROWS]], axis=1)
            if room > 1 << 8:
                yield from sums(held)
                held, room = {}, 0
            part = limbs(x)
            room += 1
            for i, left in enumerate(part):
                for j in range(i, len(part)):
                    g = (left.T @ part[j]).astype(np.int64)
                    held[i + j] = held.get(i + j, 0) + (g if i == j else g + g.T)
    yield from sums(held)


def sums(held: dict[int, np.ndarray]):
    for place, g in held.items():
        i, j = np.triu_indices(len(g))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "place": pa.array(np.full(len(i), place, np.int32)), "v": pa.array(g[i, j])})


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, per-dimension sums S and products G = sum of x x^T, as Python integers; merged by Spark, recombined here.

    The driver holds (dimensions + 1)**2 numbers, as the eigenproblem does.
    """
    parts = rows.mapInArrow(limb_products, "i int, j int, place int, v long")
    merged = parts.groupBy("i", "j", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).toPandas()
    d = int(merged["j"].max(skipna=True)) + 1 if len(merged) else 1
    g = np.zeros((d, d), object)
    for i, j, place, v in merged.itertuples(index=False):
        g[i, j] += int(v) << BITS * int(place)
    upper = np.triu_indices(d)
    g.T[upper] = g[upper]
    return int(g[0, 0]), g[0, 1:], g[1:, 1:]


def eigen(n: int, s: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), eigenvectors (columns) and trace of V = (n G - S S^T) / n**2, each entry rounded once."""
    centred = n * g - np.outer(s, s)
    v = np.array([[c / (n * n) for c in row] for row in centred.tolist()], float)
    values, vectors = np.linalg.eigh(v)
    return values[::-1], vectors[:, ::-1], sum(centred.diagonal().tolist()) / (n * n)


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> tuple[np.ndarray, list]:
    """(n x - S) / n in double, and the exact sum of squares of n x - S by row (null beyond a long)."""
    most = n * int(max(x.max(initial=0), -x.min(initial=0))) + max(abs(int(t)) for t in s)
    if most < 1 << 62:
        y = n * x - s.astype(np.int64)
        if (int(max(y.max(initial=0), -y.min(initial=0))) ** 2) * y.shape[1] < 1 << 63:
            return y / n, (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - s
    squares = (y * y).sum(axis=1).tolist()
    return (y / n).astype(float), [q if q < 1 << 63 else None for q in squares]


def whitened_products(n: int, s: np.ndarray, w: np.ndarray):
    """mapInArrow: sums of products of whitened values, by pair of components."""

    def run(batches):
        total = np.zeros((w.shape[1], w.shape[1]))
        for b in batches:
            z = deviations(matrix(b), n, s)[0] @ w
            total += z.T @ z
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "v": pa.array(total[i, j])})

    return run


def whitened_rows(n: int, s: np.ndarray, w: np.ndarray, explained: np.ndarray, error: float | None):
    """mapInArrow: a row for each vector and component."""

    def run(batches):
        k = w.shape[1]
        for b in batches:
            y, squares = deviations(matrix(b), n, s)
            z = y @ w
            m = len(z)
            repeat = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(repeat),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, n)),
                "deviation": pa.array(squares, pa.int64()).take(repeat),
                "whitened": pa.array(z.ravel(), from_pandas=True),
                "explained": pa.array(np.tile(explained, m)),
                "identity_error": pa.array([error] * (m * k), pa.float64()),
            })

    return run


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> vec_id, component, n, deviation, whitened, explained, identity_error.

    All rows are fitted and returned whose vector is not null, not empty and holds finite numbers only (those beyond
    2**62 / ``scale`` count as not finite). Vectors of another length than the commonest (of equally common ones the
    longest) have no place in the covariance and are left out. Repeated rows count each; rows without vec_id are kept.
    A component without variance (fewer different vectors than components, say) has whitened null and explained 0 and is
    not part of identity_error, which is null if none has variance. A deviation beyond a long is null. An empty table
    gives no row; other columns are ignored.

    A row is read four times (lengths, products, check, output); only sums by pair of dimensions are shuffled.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = whole_vectors(vectors, scale)
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = stored(rows.where(F.size("x") == common.d))
    n, s, g = moments(rows)
    values, axes, trace = eigen(n, s, g)
    k = min(components, len(values))
    values, axes = values[:k], axes[:, :k]
    live = values > max(values[0], 0.0) * len(axes) * np.finfo(float).eps
    w = axes / np.sqrt(np.where(live, values, np.nan))
    explained = np.where(live, values / trace, 0.0) if trace else np.zeros(k)
    error = None
    if live.any():
        m = int(live.sum())
        checked = rows.mapInArrow(whitened_products(n, s, w[:, :m]), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        error = float((checked["v"] / n - (checked["i"] == checked["j"])).abs().max())
    return rows.mapInArrow(whitened_rows(n, s, w, explained, error), schema)


def op11(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
