"""Operator 13: hard negatives by rotated one-bit codes with exact intervals.

Method. Vectors become integers, floor(256 * x). A seeded rotation (three
rounds of sign flips and Hadamard transforms, so no matrix is shipped) spreads
each vector evenly; its code keeps one sign bit per dimension. As a unit
vector the code is c = signs / sqrt(D); the stored alignment <c, v> says how
much of v lies along it. What remains is coded the same way, ``LAYERS`` times:
v = sum(alignment_l * c_l) + rest. Two vectors' inner product is then estimated
by popcounts of their codes, <c_l, c_m> = 1 - 2 * popcount(xor) / D, and by
Cauchy-Schwarz the estimate is off by no more than

    |rest_v| * |w| + |v - rest_v| * |rest_w|,

all of them stored norms. Rows whose interval cannot reach what is already
found fall out; the others are scored on the whole integer vectors. The
interval is a proof, not a guess, so the result is that of brute force.

Work. Anchors are a stated query set, searched against all rows in blocks:
rows go to cells of some ``ROWS`` rows by hash of their number, anchors to
blocks of some ``ANCHORS``, and each (block, cell) is one cogroup of bounded
size. No key of the data (label, id, equal vectors) decides where a row goes.
A cell gives at most ``TOP`` rows per anchor in the first search (positives)
and per anchor and positive in the second (negatives); a window with a rank
limit picks the best of all cells.

Defined results: rows with a null label, a null or empty vector or one with
null or non-finite entries take no part, nor do vectors of another length than
the most frequent one (the larger of ties). "Other" rows of an anchor are
those of another id; repeated rows count as rows each, as anchors too. Rows
without an id are no anchors; as candidates they come after all ids of their
score. An anchor without positives, and a positive without negatives in its
range, give no rows; a negative positive score leaves an empty range. Extra
columns are ignored; an empty table gives an empty result. An entry of 2^32
and more in size, or vectors whose products could exceed 64 bits, end the job
with an error.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import written
from .vectors import common_length, matrix, scaled, whole

SCALE = 256
LAYERS = 5
SEED = 20240117
ROWS, ANCHORS = 8192, 4096
TOP = 5
LOWEST = 80  # percent of the positive's score
CELLS = 1 << 18  # pairs estimated at a time
ITEM = "uid long, id long, label long, v array<long>, code binary, align array<double>, rest double, near double, norm double"


@lru_cache(maxsize=4)
def _flips(width: int):
    import numpy as np

    return np.random.default_rng(SEED).integers(0, 2, (3, width)) * 2.0 - 1.0


def rotate(v):
    """The rows of ``v``, padded to a power of two (64 at least) and turned;
    lengths and inner products stay."""
    import numpy as np

    width = max(64, 1 << max(0, v.shape[1] - 1).bit_length())
    x = np.zeros((len(v), width))
    x[:, :v.shape[1]] = v
    for flip in _flips(width):
        x *= flip
        half = 1
        while half < width:
            pair = x.reshape(len(x), -1, 2, half)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), width)
            half *= 2
        x /= np.sqrt(width)
    return x


def encode(v):
    """(code, alignments, |rest|, |v - rest|, |v|) of the rows of ``v``."""
    import numpy as np

    left = rotate(v)
    norm, width = np.linalg.norm(left, axis=1), left.shape[1]
    whole_, bits, align = left.copy(), [], []
    for _ in range(LAYERS):
        up = left >= 0
        along = np.abs(left).sum(axis=1) / np.sqrt(width)
        left = left - np.where(up, 1.0, -1.0) * (along / np.sqrt(width))[:, None]
        bits.append(np.packbits(up, axis=1))
        align.append(along)
    return np.stack(bits, axis=1), np.stack(align, axis=1), np.linalg.norm(left, axis=1), np.linalg.norm(whole_ - left, axis=1), norm


def _index(batches, dims):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            v = matrix(part.column("v"), dims)
            code, align, rest, near, norm = encode(v)
            if norm.max(initial=0) >= 3.0e9:
                raise OverflowError("an inner product may not fit 64 bits")
            codes = pa.array([x.tobytes() for x in code], pa.binary())
            aligns = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * LAYERS), pa.array(align.ravel()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("uid", "id", "label", "v")], codes, aligns,
                                              pa.array(rest), pa.array(near), pa.array(norm)],
                                             [x.split()[0] for x in ITEM.split(", ")])


def build_index(df: DataFrame, id_col: str, vec_col: str, label) -> DataFrame:
    """Every usable row with its codes (see ``ITEM``), written once."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & whole(F.col("v"))).withColumn("v", scaled(F.col("v"), SCALE))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()))
    dims = common_length(rows, "v")
    return written(rows.filter(F.size("v") == dims).mapInArrow(lambda it: _index(it, dims), ITEM))


class _Side:
    """Arrow columns of one side of a cell as arrays."""

    def __init__(self, table):
        import numpy as np

        self.n = n = table.num_rows
        at = lambda c: np.asarray(table[c].combine_chunks().to_numpy(zero_copy_only=False))
        self.uid, self.label = at("uid"), at("label")
        self.no_id = np.asarray(table["id"].is_null().combine_chunks().to_numpy(zero_copy_only=False))
        self.id = np.asarray(table["id"].fill_null(0).combine_chunks().to_numpy(zero_copy_only=False))
        self.v = np.asarray(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, -1)
        words = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint64).reshape(n, LAYERS, -1)
        self.code, self.width = words, words.shape[2] * 64
        self.align = np.asarray(table["align"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(n, LAYERS)
        self.rest, self.near, self.norm = at("rest"), at("near"), at("norm")

    def part(self, rows):
        import copy

        x = copy.copy(self)
        for name in ("uid", "label", "no_id", "id", "v", "code", "align", "rest", "near", "norm"):
            setattr(x, name, getattr(self, name)[rows])
        x.n = len(x.id)
        return x


def intervals(a: _Side, b: _Side):
    """Lowest and highest possible inner product of each row of ``a`` and ``b``."""
    import numpy as np

    total = np.outer(a.align.sum(axis=1), b.align.sum(axis=1))
    for i in range(LAYERS):
        apart = np.zeros(total.shape)
        for j in range(LAYERS):
            differ = np.zeros(total.shape, np.uint16)
            for w in range(a.code.shape[2]):
                differ += np.bitwise_count(a.code[:, i, w, None] ^ b.code[None, :, j, w])
            apart += differ * b.align[:, j]
        total -= apart * (a.align[:, i, None] * (2.0 / a.width))
    off = np.outer(a.rest, b.norm) + np.outer(a.near, b.rest)
    off += 1e-9 * np.outer(a.norm, b.norm) + 1e-6  # rounding
    return total - off, total + off


def _scores(rows: _Side, anchors: _Side, i, j):
    import numpy as np

    out = np.empty(len(i), np.int64)
    step = max(1, (1 << 20) // max(1, rows.v.shape[1]))
    for a in range(0, len(i), step):
        out[a:a + step] = np.einsum("ij,ij->i", rows.v[i[a:a + step]], anchors.v[j[a:a + step]])
    return out


class _Best:
    """The first ``TOP`` rows of each slot, by score and then id."""

    def __init__(self, slots: int):
        import numpy as np

        self.floor = np.full(slots, -np.inf)  # what a newcomer must reach
        self.slot = self.score = self.id = np.zeros(0, np.int64)
        self.no_id = np.zeros(0, bool)

    def add(self, slot, score, id_, no_id):
        import numpy as np

        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        id_, no_id = np.concatenate([self.id, id_]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((id_, no_id, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, int)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = order[place < TOP]
        self.slot, self.score, self.id, self.no_id = slot[place < TOP], score[keep], id_[keep], no_id[keep]
        last = place == TOP - 1
        self.floor[slot[last]] = score[order[last]]


def _table(anchors: _Side, best: _Best, slots_each: int):
    import pyarrow as pa

    return pa.table({"a": anchors.uid[best.slot // slots_each], "p": (best.slot % slots_each).astype("int32"), "score": best.score,
                     "id": pa.array(best.id, pa.int64(), mask=best.no_id)})


def _positives(left, right):
    """A cell's best rows of the same label for each anchor of a block."""
    import numpy as np

    if not left.num_rows or not right.num_rows:
        return _table_schema().empty_table()
    rows, anchors = _Side(left), _Side(right)
    best = _Best(anchors.n)
    for label in np.intersect1d(rows.label, anchors.label):
        mine = np.flatnonzero(anchors.label == label)
        some = np.flatnonzero(rows.label == label)
        step = max(16, CELLS // len(mine))
        for a in range(0, len(some), step):
            r, q = rows.part(some[a:a + step]), anchors.part(mine)
            low, high = intervals(r, q)
            own = (r.id[:, None] == q.id) & ~r.no_id[:, None]
            low[own], high[own] = -np.inf, -np.inf
            floor = best.floor[mine]
            if r.n >= TOP:
                floor = np.maximum(floor, np.partition(low, r.n - TOP, axis=0)[r.n - TOP])
            i, j = np.nonzero((high >= floor) & ~own)
            best.add(mine[j], _scores(r, q, i, j), r.id[i], r.no_id[i])
    return _table(anchors, best, 1)


def _negatives(left, right):
    """A cell's best rows of other labels for each anchor of a block and each
    of its positives, within the positive's range of scores."""
    import numpy as np

    if not left.num_rows or not right.num_rows:
        return _table_schema().empty_table()
    rows, anchors = _Side(left), _Side(right)
    # Positive scores by place; where there is none, a range that holds nothing.
    top = np.full((anchors.n, TOP), -1, np.int64)
    for k, scores in enumerate(right["scores"].to_pylist()):
        top[k, :len(scores)] = scores
    best = _Best(anchors.n * TOP)
    step = max(16, CELLS // anchors.n)
    for a in range(0, rows.n, step):
        r = rows.part(slice(a, a + step))
        low, high = intervals(r, anchors)
        other = r.label[:, None] != anchors.label
        floors = np.maximum(best.floor.reshape(anchors.n, TOP), top * (LOWEST / 100) - 1e-6)
        able = np.zeros(low.shape, bool)
        for p in range(TOP):
            able |= (high >= floors[:, p]) & (low <= top[:, p]) & (top[:, p] >= 0)
        i, j = np.nonzero(able & other)
        score = _scores(r, anchors, i, j)
        for p in range(TOP):
            most = top[j, p]
            ok = (LOWEST * most <= 100 * score) & (score <= most) & (score >= best.floor[j * TOP + p])
            best.add(j[ok] * TOP + p, score[ok], r.id[i[ok]], r.no_id[i[ok]])
    return _table(anchors, best, TOP)


def _table_schema():
    import pyarrow as pa

    return pa.schema([("a", pa.int64()), ("p", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, cells: int, find) -> DataFrame:
    """``find`` on each (block of anchors, cell of rows); the best of all."""
    left = rows.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(cells)))
    left = left.withColumn("block", F.explode(_numbers(blocks)))
    right = anchors.withColumn("cell", F.explode(_numbers(cells)))
    found = left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(
        find, "a long, p int, score long, id long")
    place = F.row_number().over(Window.partitionBy("a", "p").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= TOP)


def mine(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label=None, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the anchors, the rows whose id is divisible by
    ``every``."""
    index = build_index(df, id_col, vec_col, F.col("label") if label is None else label)
    anchors = written(index.filter(F.col("id") % every == 0))
    blocks, cells = max(1, -(-anchors.count() // ANCHORS)), max(1, -(-index.count() // ROWS))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    positives = written(_search(index, anchors, blocks, cells, _positives))
    # At most TOP a group; the place is the positive's index in the scores.
    scores = positives.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"))
    scores = scores.select(F.col("a").alias("uid"), F.col("s.score").alias("scores"))
    negatives = _search(index, anchors.join(scores, "uid"), blocks, cells, _negatives)
    out = (negatives.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
           .join(positives.select("a", (F.col("rank") - 1).alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["a", "p"])
           .join(anchors.select(F.col("uid").alias("a"), F.col("id").alias("anchor_id")), "a"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
