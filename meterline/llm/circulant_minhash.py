"""Operator 12: near duplicates by circulant MinHash, verified exactly.

Method. Two permutations make every coordinate of a signature. The first one
(a bijective mix of the 64-bit shingle hash) gives each shingle its place on
a circle of ``PLACES`` slots; the second one numbers the slots. Coordinate k
of a set is the smallest number at the set's places after the numbers were
shifted by k along the circle. With the numbers stored once and their start
repeated at the end, the coordinates of one shingle are one contiguous run of
that table, and a signature is the running minimum over such runs.

Banding. ``rows`` coordinates side by side are hashed to one key; ``bands``
of them are chosen so that two sets right at the threshold share no key with
a probability below ``MISS``. Both permutations come from fixed seeds: equal
input gives equal output.

Copies and hot keys. Texts with equal sets are one class (62-bit hash of the
set, held against a second 64-bit hash, an error if they ever disagree), so
exact copies cost a row each and make no pairs. A key with many classes makes
no table of all their pairs either:

1. in every key the classes meet the key's smallest class (linear); links
   found make components, by alternating large and small stars;
2. a key whose classes are in one component by now is settled. In the others
   classes of different components meet: up to ``LIMIT`` classes a key by a
   join, larger keys in cells of some ``CELL`` classes. A task gets two cells
   of a key with their sketches and shingle sets, compares each pair under the
   first key it shares only, and gives no more links than join components.

A sketch is the low byte of every coordinate. A pair goes on to the exact
check if as many bytes agree as all but ``MISS`` of the pairs at the
threshold have; texts that only share a passage, or copies that were changed
too much, part there at a byte per coordinate.

Every pair is verified exactly on the two whole shingle sets, so a wrong
candidate costs time and never a wrong link.

Defined results: null or empty texts and texts without words have no
shingles, link with nothing and are their own component; repeated rows each
give a row; a row without an id takes the smallest id of its component, if
any (``kept`` is then false, and true where the component has no id at all);
extra columns are ignored; an empty table gives an empty result; a very long
text fills its places on the circle more than once, which makes candidates
and loses none.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_broadcast
from .jaccard_join import shingle_sets
from .scratch import components, written

SHINGLE = 3
PERCENT = 85
ROWS = 8
MISS = 1e-8
PLACES = 1 << 20
LIMIT = 16
CELL = 1024
MAX_BROADCAST = 2_000_000  # representatives of 16 bytes
SEEDS = (0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D)


def bands(percent: int, rows: int, miss: float = MISS) -> int:
    """Bands needed so that sets of this similarity share none with a
    probability of ``miss`` at most."""
    if percent >= 100:
        return 1
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def least_equal(percent: int, length: int, miss: float = MISS) -> int:
    """The most equal coordinates of ``length`` that two sets of this
    similarity miss with a probability of ``miss`` at most (binomial tail)."""
    p, below = percent / 100, 0.0
    if p >= 1:
        return length
    for k in range(length + 1):
        below += math.exp(math.lgamma(length + 1) - math.lgamma(k + 1) - math.lgamma(length - k + 1)
                          + k * math.log(p) + (length - k) * math.log1p(-p))
        if below > miss:
            return k
    return length


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=2)
def _runs(length: int):
    """Row p: the numbers of the ``length`` slots from place p on."""
    import numpy as np

    numbers = np.argsort(_mix(np.arange(PLACES, dtype=np.uint64) + np.uint64(SEEDS[1]))).astype(np.uint32)
    ring = np.concatenate([numbers, numbers[:length - 1]])
    return np.lib.stride_tricks.sliding_window_view(ring, length)


def signature(shingles, length: int):
    """The circulant MinHash signature of a non-empty set of hashes."""
    import numpy as np

    runs = _runs(length)
    places = (_mix(shingles ^ np.uint64(SEEDS[0])) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
    step = max(1, (1 << 18) // length)
    best = runs[places[:step]].min(axis=0)
    for a in range(step, len(places), step):
        np.minimum(best, runs[places[a:a + step]].min(axis=0), out=best)
    return best


def band_keys(at, rows: int):
    """One 64-bit key per band of a signature."""
    import numpy as np

    at = at.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(at), dtype=np.uint64)
    for j in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + at[:, j])
    return key.view(np.int64)


def _class_of(shingles) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return d & (2**62 - 1), (d >> 64) - 2**63


def _describe(batches, size, n_bands, id_type, names):
    """Per document: id, set size, class and check; the band keys and the
    sketch of a class where this task sees it first."""
    import numpy as np
    import pyarrow as pa

    seen = set()
    for batch in batches:
        ns, classes, checks, keys, sketches = [], [], [], [], []
        for s in shingle_sets(batch.column(1), size):
            c, check = _class_of(s) if len(s) else (None, None)
            ns.append(len(s))
            classes.append(c)
            checks.append(check)
            if c is None or c in seen:
                keys.append(None)
                sketches.append(None)
            else:
                seen.add(c)
                at = signature(s, n_bands * ROWS)
                keys.append(band_keys(at, ROWS))
                sketches.append(at.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([
            batch.column(0).cast(id_type), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()),
            pa.array(checks, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names)


def _set_rows(batches, size, id_type):
    """(id, class, shingles), once per task for each id and class."""
    import pyarrow as pa

    seen = set()
    for batch in batches:
        out = []
        for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size)):
            if len(s) and (key := (i, _class_of(s)[0])) not in seen:
                seen.add(key)
                out.append((*key, s.tobytes()))
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                                         ["id", "class", "shingles"])


def _alike(batches, percent, least):
    """(a, b) of the pairs whose sketches and sizes allow a link."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        a, b, na, nb, x, y = batch.columns
        if not batch.num_rows:
            continue
        flat = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1)
        na, nb = na.to_numpy(), nb.to_numpy()
        ok = ((flat(x) == flat(y)).sum(axis=1) >= least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _cell_links(table, percent, least):
    """(a, b): verified links that join components, of classes in two cells
    of a key (or within one), for pairs that share no earlier key."""
    import numpy as np
    import pyarrow as pa

    at = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    classes, roots, n, cell = at("class"), at("root"), at("n"), at("cell")
    lo, hi, key = table["lo"][0].as_py(), table["hi"][0].as_py(), table["key"][0].as_py()
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(n), -1)
    keys = table["keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
    shingles, coded = np.unique(np.frombuffer(b"".join(table["shingles"].to_pylist()), np.uint64), return_inverse=True)
    ends = np.cumsum(n)
    group = np.unique(roots, return_inverse=True)[1]  # one number per component met so far
    left, right = np.flatnonzero(cell == lo), np.flatnonzero(cell == hi)
    found, mark = [], np.zeros(len(shingles), bool)
    for k, i in enumerate(left):
        others = right[k + 1:] if lo == hi else right
        others = others[(group[others] != group[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
        others = others[(sketch[others] == sketch[i]).sum(axis=1) >= least]
        if len(others):
            others = others[keys[i][(keys[others] == keys[i]).argmax(axis=1)] == key]
            mine = coded[ends[i] - n[i]:ends[i]]
            mark[mine] = True
            for j in others:
                if group[j] != group[i]:
                    both = np.count_nonzero(mark[coded[ends[j] - n[j]:ends[j]]])
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        found.append((classes[i], classes[j]))
                        group[group == group[j]] = group[i]
            mark[mine] = False
    a, b = zip(*found) if found else ([], [])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verify(batches, percent):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(100 * both >= percent * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _shared(entries: DataFrame) -> DataFrame:
    """(key, class), distinct, of the keys that more than one class has."""
    keys = entries.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("key")
    return entries.join(keys, "key", "left_semi").distinct()


class _Groups:
    """Classes of equal sets, and the components they make."""

    def __init__(self, docs: DataFrame, percent: int, id_col: str, text_col: str, size: int):
        from pyspark.sql.pandas.types import to_arrow_type

        self.percent, self.size = percent, size
        self.named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
        self.id_field = self.named.schema["id"]
        id_type = self.id_type = to_arrow_type(self.id_field.dataType)
        n_bands = bands(percent, ROWS)
        self.least = least_equal(percent, n_bands * ROWS)
        names = ["id", "n_shingles", "class", "check", "keys", "sketch"]
        schema = T.StructType([self.id_field, *[T.StructField(c, T.LongType()) for c in names[1:4]],
                               T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
        self.described = written(self.named.mapInArrow(lambda it: _describe(it, size, n_bands, id_type, names), schema))
        apart = F.when(F.min("check") != F.max("check"), F.raise_error(F.lit("two shingle sets share a class hash")))
        self.classes = written(self.described.filter("n_shingles > 0").groupBy("class").agg(
            F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.coalesce(apart.cast("long"), F.min("check")).alias("check")))
        self.roots = None

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(class, shingles) of the wanted classes, from the text of each
        one's representative."""
        size, id_type = self.size, self.id_type
        schema = T.StructType([self.id_field, T.StructField("class", T.LongType()), T.StructField("shingles", T.BinaryType())])
        reps = written(wanted.distinct().join(self.classes, "class").select(F.col("class").alias("c"), F.col("rep").alias("r")))
        few = bounded_broadcast(reps, MAX_BROADCAST)
        # Only texts of representatives are cut again.
        texts = self.named.join(few, F.col("id").eqNullSafe(F.col("r")), "left_semi")
        rows = texts.mapInArrow(lambda it: _set_rows(it, size, id_type), schema)
        rows = rows.join(few, (F.col("class") == F.col("c")) & F.col("id").eqNullSafe(F.col("r")), "left_semi")
        return written(rows.select("class", "shingles").dropDuplicates(["class"]))

    def alike(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs whose sketches and sizes allow a link."""
        side = lambda c: sketches.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        percent, least = self.percent, self.least
        return both.mapInArrow(lambda it: _alike(it, percent, least), "a long, b long")

    def compare(self, pairs: DataFrame, sets: DataFrame, more: DataFrame | None = None) -> None:
        """Verifies the pairs and takes their links, and ``more`` links, into
        the components."""
        both = (pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")
                .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb"))
        percent = self.percent
        links = both.mapInArrow(lambda it: _verify(it, percent), "a long, b long")
        links = written(links if more is None else links.unionByName(more))
        if self.roots is not None:  # what was found before, as one star per component
            links = links.unionByName(self.roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.roots = written(components(links, "a", "b"))

    def open(self, entries: DataFrame) -> DataFrame:
        """(key, class, root, c) of the keys whose classes lie in more than
        one component; c is the key's number of classes."""
        rooted = entries.join(self.roots.withColumnRenamed("node", "class"), "class", "left").select(
            "key", "class", F.coalesce("root", "class").alias("root"))
        per = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo < hi")
        return written(rooted.join(per.select("key", "c"), "key"))

    def link(self) -> None:
        signed = self.described.filter("keys is not null").select(F.explode("keys").alias("key"), "class")
        entries = written(_shared(signed))
        wanted = entries.select("class").distinct()
        sketches = self.described.filter("keys is not null").select("class", F.col("n_shingles").alias("n"), "keys", "sketch")
        sketches = written(sketches.join(wanted, "class", "left_semi").dropDuplicates(["class"]))
        sets = self.sets(wanted)

        # Step 1: each key's classes meet its smallest one.
        firsts = entries.groupBy("key").agg(F.min("class").alias("a"))
        star = entries.join(firsts, "key").filter("a < class").select("a", F.col("class").alias("b"))
        self.compare(written(self.alike(star, sketches)), sets)

        # Step 2: across components.
        left = self.open(entries)
        few = left.filter(F.col("c") <= LIMIT)
        x = few.select("key", F.col("class").alias("a"), F.col("root").alias("ra"))
        y = few.select("key", F.col("class").alias("b"), F.col("root").alias("rb"))
        pairs = self.alike(x.join(y, "key").filter("a < b and ra <> rb").select("a", "b"), sketches)
        many = left.filter(F.col("c") > LIMIT).withColumn("cells", F.ceil(F.col("c") / CELL).cast("long"))
        many = many.withColumn("cell", F.pmod(F.xxhash64("class"), F.col("cells")))
        many = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("other"))
        many = many.withColumn("lo", F.least("cell", "other")).withColumn("hi", F.greatest("cell", "other"))
        many = many.join(sketches, "class").join(sets, "class")
        many = many.select("key", "lo", "hi", "cell", "class", "root", "n", "keys", "sketch", "shingles")
        percent, least = self.percent, self.least
        found = many.groupBy("key", "lo", "hi").applyInArrow(lambda t: _cell_links(t, percent, least), "a long, b long")
        self.compare(written(pairs), sets, found)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id (the
    smallest id reachable over links, itself included) and kept."""
    groups = _Groups(docs, percent, id_col, text_col, size)
    groups.link()
    classes = groups.classes.join(groups.roots.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "rep", F.coalesce("root", "class").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = classes.select("class", "root").join(lowest, "root").select("class", "component_id")
    out = groups.described.join(found, "class", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
