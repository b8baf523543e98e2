"""Operator 11: embedding whitening by polarisation covariance.

Method. Entries become integers x; n and the sums S of all vectors come from
one pass. A second pass aggregates exact squares of centred values only: of
every dimension and of every sum of two dimensions. Since

    var(i + j) = var(i) + var(j) + 2 cov(i, j),

differences of variances give all cross-covariances, as integers: the squares
are summed of z = x - floor(S / n), and what the floor left out (r = S - n *
floor(S / n)) enters exactly, sum((n*x - S)^2) = n^2 * sum(z^2) - n * r^2, for
dimensions and for sums of two alike. One division each rounds the result to
double; the matrix is assembled for ``eigh`` on the driver. What reaches the
driver is one row per pair of dimensions, however many vectors there are:
tasks send one partial sum per pair and Spark adds them up.

The components are numbered by falling eigenvalue; of either sign the one
whose largest entry is positive is taken. ``whitened`` is the projection of
x - S/n on a component over the root of its eigenvalue; its covariance is
aggregated again from the whitened rows (``covar_pop``, which centres and
merges) and held against the identity.

Defined results: rows whose vector is null, empty or holds null or non-finite
entries are dropped; so are vectors of another length than the most frequent
one (the larger of ties), which no covariance has a place for. Repeated rows
and rows without an id each take part and give their rows. A component
without variance (equal vectors, a single vector, fewer vectors than
dimensions) gives a null ``whitened``; ``explained`` is null where nothing
varies; ``identity_error`` covers the components that vary, null without any.
An empty table gives an empty result. Extra columns are ignored. An entry
beyond 2^30 in size or a deviation beyond 64 bits ends the job with an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written
from .vectors import common_length, matrix, scaled, whole

SCALE, SHIFT = 1024, 100000
COMPONENTS = 8
STEP = 4096  # rows squared at a time


@dataclass(frozen=True)
class Whitening:
    """Fitted on n integer vectors: per-dimension sums, the covariance's
    leading components and all of its eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    covariance: tuple[tuple[float, ...], ...]
    values: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def trace(self) -> float:
        return math.fsum(self.covariance[i][i] for i in range(self.dims))

    def varies(self, k: int) -> bool:
        return self.values[k] > max(self.dims, 1) * 2.0**-50 * self.values[0]


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) of the usable rows, written once, and the number of dimensions."""
    usable = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(whole(F.col("v")))
    x = written(usable.select("id", scaled(F.col("v"), SCALE, SHIFT).alias("x")))
    dims = common_length(x, "x")
    return x.filter(F.size("x") == dims), dims


def _sums(batches, dims):
    """One (at, n, total) per dimension and task."""
    import pyarrow as pa

    n, total = 0, [0] * dims
    for batch in batches:
        x = matrix(batch.column(0), dims)
        for a in range(0, len(x), STEP):
            part = x[a:a + STEP]  # 2^12 entries below 2^41 each
            n += len(part)
            total = [t + s for t, s in zip(total, part.sum(axis=0).tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                                      pa.array(total, pa.decimal128(38))], ["at", "n", "total"])


def _squares(batches, centre):
    """One (i, j, total) per task: the squares of the centred dimension i
    (i = j), or of the sum of the centred dimensions i and j, added up."""
    import numpy as np
    import pyarrow as pa

    dims, middle = len(centre), np.array(centre, np.int64)
    pairs = list(combinations_with_replacement(range(dims), 2))
    total = [0] * len(pairs)
    for batch in batches:
        x = matrix(batch.column(0), dims)
        for a in range(0, len(x), STEP):
            z = x[a:a + STEP] - middle
            most = int(np.abs(z).max(initial=0))
            if 4 * most * most * len(z) >= 1 << 62:
                z = z.astype(object)  # whole numbers of any size
            found = []
            for i in range(dims):
                w = z[:, i:].copy()
                w[:, 1:] += z[:, i:i + 1]
                found.extend((w * w).sum(axis=0).tolist())
            total = [t + s for t, s in zip(total, found)]
    i, j = zip(*pairs)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total, pa.decimal128(38))],
                                     ["i", "j", "total"])


def fit(x: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of integer vectors ``x``; None without any."""
    import numpy as np

    if not dims:
        return None
    rows = x.select("x").mapInArrow(lambda it: _sums(it, dims), "at int, n long, total decimal(38,0)")
    rows = rows.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect()
    n, sums = rows[0]["n"], tuple(int(r["total"]) for r in rows)
    centre = tuple(s // n for s in sums)
    rest = [s - n * c for s, c in zip(sums, centre)]
    rows = x.select("x").mapInArrow(lambda it: _squares(it, centre), "i int, j int, total decimal(38,0)")
    square = {(r["i"], r["j"]): int(r["total"]) for r in rows.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    # Sums of (n*x - S)^2, of single dimensions and of sums of two.
    alone = [n * n * square[i, i] - n * rest[i] ** 2 for i in range(dims)]
    cov = np.zeros((dims, dims))
    for i, j in combinations_with_replacement(range(dims), 2):
        if i == j:
            product = alone[i]
        else:
            product = (n * n * square[i, j] - n * (rest[i] + rest[j]) ** 2 - alone[i] - alone[j]) // 2
        cov[i, j] = cov[j, i] = product / n**3
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    top = []
    for k in order[:components]:
        u = vectors[:, k]
        top.append(tuple((u if u[np.argmax(np.abs(u))] > 0 else -u).tolist()))
    return Whitening(n, sums, tuple(map(tuple, cov.tolist())), tuple(np.maximum(values[order], 0).tolist()), tuple(top))


def _apply(batches, model, id_type):
    import numpy as np
    import pyarrow as pa

    n = model.n
    centre = np.array([s // n for s in model.sums], np.int64)
    rest = np.array([s % n for s in model.sums], np.int64)
    some = [k for k in range(len(model.components)) if model.varies(k)]
    turn = np.array([[u / math.sqrt(model.values[k]) for u in model.components[k]] for k in some]).reshape(len(some), model.dims).T
    for batch in batches:
        z = matrix(batch.column(1), model.dims) - centre
        if ((z * float(n) - rest) ** 2).sum(axis=1).max(initial=0) >= 2.0**63:
            raise OverflowError("a deviation does not fit 64 bits")
        deviation = ((n * z - rest) ** 2).sum(axis=1)
        w = np.full((len(z), len(model.components)), np.nan)
        w[:, some] = (z - rest / n) @ turn
        flat = pa.array(w.ravel(), from_pandas=True)
        at = pa.array(np.arange(len(z) + 1, dtype=np.int32) * w.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(deviation), pa.ListArray.from_arrays(at, flat)],
                                         ["id", "deviation", "w"])


def whiten(x: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, w): whitened coordinates of integer vectors."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(x.schema["id"].dataType)
    schema = T.StructType([x.schema["id"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    return x.select("id", "x").mapInArrow(lambda it: _apply(it, model, id_type), schema)


def identity_error(white: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    some = [k for k in range(len(model.components)) if model.varies(k)]
    pairs = list(combinations_with_replacement(some, 2))
    if not pairs:
        return None
    w = lambda k: F.col("w")[k]
    found = white.agg(*[F.covar_pop(w(i), w(j)).alias(f"c_{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c_{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten_embeddings(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: ``id_col``, component, n,
    deviation, whitened, explained and identity_error."""
    x, dims = integer_vectors(df, id_col, vec_col)
    model = fit(x, dims, components)
    if model is None:
        kind = df.schema[id_col].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, "
                                                   "explained double, identity_error double")
    white = written(whiten(x, model))
    error = identity_error(white, model)
    share = F.array(*[F.lit(e / model.trace if model.trace > 0 else None).cast("double") for e in model.values[:len(model.components)]])
    out = white.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                      "whitened", F.element_at(share, F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
