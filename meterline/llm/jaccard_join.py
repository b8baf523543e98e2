"""Operator 7: exact Jaccard self-join of word shingles, as components.

Method: universe partition and pigeonhole. With a similarity of at least
``percent`` two sets of sizes a and b differ in at most
``H = (a + b) * (100 - percent) / (100 + percent)`` elements. Sizes fall into
bands so that similar sets lie in the same or in neighbouring bands; the hash
universe of a band is cut into m segments (a few more than H + 1), and each
set's subset in a segment is hashed to one key. If a set has more than H
non-empty segments, a similar set equals it in one of them at least. A set
therefore gives its keys once for its own band and once, as the smaller
partner, for the next (a "unit" is a set in one of these two roles).

Allocation by cost. A key of more than ``LIMIT`` units is costly: it is often
a passage that many texts share. A unit that has at least H + 1 cheap keys
(``costly <= slack``) can leave its costly ones out without losing a partner,
since one of its cheap keys must be shared. Only units that cannot go on:

1. within each costly key they are compared with the smallest unit of the
   key (a group of near copies becomes one component that way, in linear
   work); keys whose units are all in one component by then are settled;
2. units that still lack cheap or settled keys get a finer partition with
   one-deletion neighbourhoods: a segment of two shingles or more whose key
   and deletions are all cheap counts twice, another one whose key is cheap
   once (a single shingle's deletion leaves nothing that a partner has a key
   of), others not at all;
3. what lacks even then is compared across components within its costly keys,
   cut into cells of some ``CELL`` units. A task gets two cells of a key with a
   bitmap of each set (the parity of its shingles' hashes on ``BITS`` places a
   shingle or more); two sets differ in as many shingles as their bitmaps in
   bits at least, so pairs beyond the allowed difference fall out there.

Every candidate pair is verified exactly on the two whole shingle sets. No
step drops a candidate: each only skips what another must find.

Shingles and words are 64-bit hashes, compared exactly as such; sets that are
equal form one class (62-bit hash, checked by a second 64-bit hash, an error
if they ever disagree), and only classes are joined, so exact copies cost one
row each and are not expanded into pairs.

Defined results: null or empty texts and texts without words have no
shingles, link with nothing and are their own component; repeated rows each
give a row; a row without an id takes the smallest id of its component, if
any; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_broadcast
from .scratch import components, written

SHINGLE = 5
LIMIT = 12
CELL = 1024
BITS = 1  # of a bitmap, per shingle
KEYS = 256  # of a unit's costly keys that go along, so that a pair is not given under each of them
MAX_BROADCAST = 2_000_000  # classes of 8 bytes


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, size: int):
    """For each text of an Arrow string array the sorted distinct 64-bit
    shingle hashes: ASCII letters in lower case, words between ASCII white
    space; fewer words than ``size`` make one shingle, none make none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A"):ord("Z") + 1] += 32
    lower[9:14] = 32
    step = 512
    for a in range(0, len(texts), step):
        part = pc.fill_null(texts.slice(a, step), "").cast(pa.large_string())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
        raw = part.buffers()[2]
        data = lower[np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]] if raw is not None else lower[:0]
        offsets = offsets - offsets[0]
        # Words: runs of other bytes, cut at the texts' ends, stored without the spaces.
        solid = data != 32
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = solid[begins]
        at = np.flatnonzero(first)
        places = np.append(np.cumsum(solid)[at] - 1, np.count_nonzero(solid)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(data[solid])])
        coded = words.dictionary_encode()
        named = coded.dictionary.to_pylist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in named), np.uint64, len(named))
        h = hashes[coded.indices.to_numpy()]
        ends = np.searchsorted(at, offsets[1:])
        n = len(h)
        total = np.full(max(n - size + 1, 0), (size * 0x9E3779B97F4A7C15) & (2**64 - 1), np.uint64)
        for i in range(size if n >= size else 0):
            total = total * np.uint64(0xD6E8FEB86659FD93) + h[i:n - size + 1 + i]
        total = _mix(total)
        start = 0
        for end in ends.tolist():
            k = end - start
            if k >= size:
                s = np.sort(total[start:end - size + 1])
                yield s if k == size else s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif k:
                x = (k * 0x9E3779B97F4A7C15) & (2**64 - 1)
                for w in h[start:end].tolist():
                    x = (x * 0xD6E8FEB86659FD93 + w) & (2**64 - 1)
                yield _mix(np.array([x], np.uint64))
            else:
                yield h[:0]
            start = end


def bands(percent: int, top: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands: similar sizes are at most one apart."""
    lows = [1]
    while lows[-1] < top:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * 100 // percent)))
    return lows


def differences(a: int, b: int, percent: int) -> int:
    return (a + b) * (100 - percent) // (100 + percent)


def roles(n: int, lows: list[int], percent: int) -> list[tuple[int, int, int]]:
    """(band, segments, least shared) of a set of ``n`` elements in its two
    roles: least is H + 1 for its largest partner of that role."""
    import bisect

    band = bisect.bisect_right(lows, n) - 1
    most = n * 100 // percent
    out = []
    for role in (0, 1):
        high = lows[band + role + 1] - 1
        h = differences(high, high, percent) + 1
        partner = min(most, high) if role == 0 else most
        out.append((band + role, h + max(1, -(-h * 8 // 100)) if h > 1 else 1, differences(n, max(n, partner), percent) + 1))
    return out


def segment_keys(shingles, band: int, m: int, salt: int):
    """Keys, starts and segment numbers of the non-empty segments."""
    import numpy as np

    segment = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    inner = _mix(shingles + np.uint64(0x632BE59BD9B4E019))
    sums = np.add.reduceat(inner, starts)
    base = _mix(segment[starts] + np.uint64((band << 32) + salt))
    return _mix(sums + base), starts, segment[starts], inner, sums, base


def non_empty(shingles, m: int) -> int:
    """Number of non-empty segments of ``m``."""
    import numpy as np

    segment = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    return 1 + int(np.count_nonzero(segment[1:] != segment[:-1]))


def _class_of(shingles) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return d & (2**62 - 1), (d >> 64) - 2**63


def _describe(batches, size, percent, names, id_type):
    """Per document: id, set size, class, check, the slack of both roles and
    the text's key."""
    import pyarrow as pa

    lows = bands(percent)
    for batch in batches:
        out = []
        for s in shingle_sets(batch.column(1), size):
            if len(s):
                slack = [non_empty(s, m) - least for _, m, least in roles(len(s), lows, percent)]
                out.append((len(s), *_class_of(s), *slack))
            else:
                out.append((0, None, None, None, None))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), *[pa.array(c, pa.int64()) for c in cols], batch.column(2)], names)


def _sign(batches, size, percent):
    """(key, unit) of each class that this task has not given yet."""
    import numpy as np
    import pyarrow as pa

    lows, seen = bands(percent), set()
    for batch in batches:
        keys, units, lens = [], [], []
        for s in shingle_sets(batch.column(0), size):
            if not len(s) or (c := _class_of(s)[0]) in seen:
                continue
            seen.add(c)
            for role, (band, m, _) in enumerate(roles(len(s), lows, percent)):
                keys.append(segment_keys(s, band, m, 0)[0])
                units.append(2 * c + role)
                lens.append(len(keys[-1]))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                                              pa.array(np.repeat(np.array(units, np.int64), lens))], ["key", "unit"])


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


def _neighbourhoods(batches, percent):
    """Finer partition with one-deletion neighbourhoods: (key, unit, segment,
    deleted) of each class in both roles, and how much each must count."""
    import numpy as np
    import pyarrow as pa

    lows = bands(percent)
    for batch in batches:
        for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = np.frombuffer(data, np.uint64)
            for role, (band, m, least) in enumerate(roles(len(s), lows, percent)):
                exact, starts, segment, inner, sums, base = segment_keys(s, band, 2 * m, 1)
                lens = np.diff(np.concatenate([starts, [len(s)]]))
                many = np.repeat(lens > 1, lens)  # empty segments have no keys to meet
                less = _mix(np.repeat(sums, lens) - inner + np.repeat(base, lens))[many]
                keys = np.concatenate([exact, less]).view(np.int64)
                n = len(keys)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys), pa.array(np.full(n, 2 * c + role, np.int64)),
                    pa.array(np.concatenate([segment, np.repeat(segment, lens)[many]]).astype(np.int64)),
                    pa.array(np.arange(n) >= len(exact)), pa.array(np.full(n, least, np.int64))],
                    ["key", "unit", "segment", "deleted", "least"])


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


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, size: int):
        self.percent, self.size = percent, size
        self.text = docs.select(F.col(text_col).cast("string").alias("t"))
        self.named = named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
        self.names = ["id", "n_shingles", "class", "check", "slack0", "slack1", "key"]
        id_field = named.schema["id"]
        schema = T.StructType([id_field, *[T.StructField(c, T.LongType()) for c in self.names[1:]]])
        from pyspark.sql.pandas.types import to_arrow_type

        self.id_field, self.id_type = id_field, to_arrow_type(id_field.dataType)
        id_type, names = self.id_type, self.names
        self.described = written(named.withColumn("key", F.xxhash64("t")).mapInArrow(lambda it: _describe(it, size, percent, names, id_type), schema))
        apart = F.when(F.min("check") != F.max("check"), F.raise_error(F.lit("two shingle sets share a class hash")))
        self.classes = written(self.described.filter("n_shingles > 0").groupBy("class").agg(
            F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("slack0").alias("slack0"),
            F.first("slack1").alias("slack1"), F.coalesce(apart.cast("long"), F.min("check")).alias("check")))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(class, shingles) of the wanted classes, from the text of each
        one's representative."""
        size, id_type = self.size, self.id_type
        schema = T.StructType([self.id_field, T.StructField("class", T.LongType()), T.StructField("shingles", T.BinaryType())])
        rows = self.named.mapInArrow(lambda it: _set_rows(it, size, id_type), schema)
        reps = written(wanted.distinct().join(self.classes, "class").select(F.col("class").alias("c"), F.col("rep").alias("r")))
        return written(rows.join(bounded_broadcast(reps, MAX_BROADCAST), (F.col("class") == F.col("c")) & F.col("id").eqNullSafe(F.col("r")),
                                 "left_semi").select("class", "shingles"))

    def units(self) -> DataFrame:
        """(unit, n, slack) of all classes in both roles."""
        return self.classes.select(F.inline(F.array(*[F.struct(
            (2 * F.col("class") + r).alias("unit"), F.col("n"), F.col(f"slack{r}").alias("slack")) for r in (0, 1)])))

    def similar_sizes(self, pairs: DataFrame) -> DataFrame:
        """Pairs of classes whose sizes allow a link."""
        c = self.classes.select("class", "n")
        p = (pairs.join(c.select(F.col("class").alias("a"), F.col("n").alias("na")), "a")
             .join(c.select(F.col("class").alias("b"), F.col("n").alias("nb")), "b"))
        return p.filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")).select("a", "b")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that link, compared on their whole sets."""
        percent = self.percent
        both = (pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")
                .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb"))
        return written(both.mapInArrow(lambda it: _verify(it, percent), "a long, b long"))


def _class(unit: str):
    return F.shiftright(F.col(unit), 1)


def _pairs(entries: DataFrame, extra: str | None = None) -> DataFrame:
    """Unit pairs of each key; two smaller partners make none (their own band does)."""
    x = entries.select("key", F.col("unit").alias("x"), *([F.col(extra).alias("ex")] if extra else []))
    y = entries.select("key", F.col("unit").alias("y"), *([F.col(extra).alias("ey")] if extra else []))
    p = x.join(y, "key").filter("x < y and (x & 1) + (y & 1) < 2 and shiftright(x, 1) <> shiftright(y, 1)")
    return p


def _as_classes(p: DataFrame) -> DataFrame:
    return p.select(F.least(_class("x"), _class("y")).alias("a"), F.greatest(_class("x"), _class("y")).alias("b")).distinct()


def _edges(roots: DataFrame) -> DataFrame:
    """The components found so far, as links: later ones only join them."""
    return roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _bitmaps(batches):
    """(class, n, bitmap): the parity bitmap of each set, ``BITS`` places a
    shingle or more, a power of two."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        out = []
        for c, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = np.frombuffer(x.as_buffer(), np.uint64)
            places = 1 << max(6, (BITS * len(s) - 1).bit_length())
            odd = np.bincount((_mix(s) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
            out.append((c, len(s), np.packbits(odd.astype(bool)).tobytes()))
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                                         ["class", "n", "bitmap"])


def _cell_pairs(table, percent):
    """(a, b): classes of different roots in two cells of a key (or within
    one) that can link by their bitmaps, where they share no earlier key of
    those that came along."""
    import numpy as np
    import pyarrow as pa

    at = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    classes, roots, n, cell = at("class"), at("root"), at("n"), at("cell")
    lo, hi, key = table["lo"][0].as_py(), table["hi"][0].as_py(), table["key"][0].as_py()
    maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["bitmap"].combine_chunks()]
    size = min(len(x) for x in maps)  # places are low bits of a hash: halves fold onto each other
    maps = np.stack([np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in maps])
    keys = [x.values.to_numpy() for x in table["keys"].combine_chunks()]
    left, right, out = np.flatnonzero(cell == lo), np.flatnonzero(cell == hi), []
    for k, i in enumerate(left):
        others = right[k + 1:] if lo == hi else right
        others = others[(roots[others] != roots[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
        total = n[others] + n[i]
        apart = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
        for j in others[apart <= total * (100 - percent) // (100 + percent)]:
            same = np.intersect1d(keys[i], keys[j], assume_unique=True)
            if not len(same) or same[0] >= key:
                out.append((classes[i], classes[j]))
    a, b = zip(*out) if out else ([], [])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _costly_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of classes of different roots that share a key of
    ``left`` (key, unit, root) and can link by their bitmaps."""
    keys = left.groupBy("unit").agg(F.slice(F.sort_array(F.collect_list("key")), 1, KEYS).alias("keys"))
    wanted = left.select(_class("unit").alias("class")).distinct()
    bitmaps = written(sets.join(wanted, "class", "left_semi").select("class", "shingles").mapInArrow(
        _bitmaps, "class long, n long, bitmap binary"))
    sizes = left.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("long").alias("cells"))
    many = left.join(sizes, "key").withColumn("cell", F.pmod(F.xxhash64("unit"), F.col("cells")))
    many = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("other"))
    many = many.withColumn("class", _class("unit")).join(keys, "unit").join(bitmaps, "class")
    many = many.select("key", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), "cell", "class", "root", "n",
                       "keys", "bitmap")
    found = many.groupBy("key", "lo", "hi").applyInArrow(lambda t: _cell_pairs(t, percent), "a long, b long")
    return found.filter("a < b").distinct()


def link_classes(join: _Join) -> DataFrame:
    """(node, root): components of classes under all links."""
    size, percent = join.size, join.percent
    signed = join.text.mapInArrow(lambda it: _sign(it, size, percent), "key long, unit long")
    from pyspark.sql import Window

    w = Window.partitionBy("key")
    shared = (signed.withColumn("lo", F.min("unit").over(w)).withColumn("hi", F.max("unit").over(w)).filter("lo < hi")
              .select("key", "unit").distinct())
    shared = written(shared)
    sizes = shared.groupBy("key").agg(F.count("*").alias("c"))
    entries = written(shared.join(sizes, "key"))
    cheap, costly = entries.filter(F.col("c") <= LIMIT), entries.filter(F.col("c") > LIMIT)

    # What each unit must share of its cheap keys: all keys less those that may differ, less the costly ones.
    costs = costly.groupBy("unit").agg(F.count("*").alias("costly"))
    units = written(join.units().join(costs, "unit", "left").withColumn("short", F.coalesce("costly", F.lit(0)) - F.col("slack")))
    counted = _pairs(cheap).groupBy("x", "y").agg(F.count("*").alias("shared"))
    needs = lambda u: units.select(F.col("unit").alias(u), (1 - F.col("short")).alias(f"need_{u}"))
    counted = counted.join(needs("x"), "x").join(needs("y"), "y").filter("shared >= need_x and shared >= need_y")

    # Step 1: units short of cheap keys meet the smallest one of each costly key.
    short = units.filter("short > 0")
    left = written(costly.join(short.select("unit"), "unit", "left_semi").select("key", "unit"))
    firsts = left.groupBy("key").agg(F.min("unit").alias("x"))
    star = left.join(firsts, "key").select("x", F.col("unit").alias("y")).filter("shiftright(x, 1) <> shiftright(y, 1)")
    pairs = written(join.similar_sizes(_as_classes(counted).union(_as_classes(star)).distinct()))
    # All later candidates are units that are short of cheap keys, too.
    sets = join.sets(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(short.select(_class("unit"))))
    links = join.verified(pairs, sets)
    roots = written(components(links, "a", "b"))

    # Keys whose units are in one component by now are settled.
    def unsettled(of: DataFrame, roots: DataFrame) -> DataFrame:
        rooted = of.withColumn("class", _class("unit")).join(roots.withColumnRenamed("node", "class"), "class", "left").select(
            "key", "unit", F.coalesce("root", "class").alias("root"))
        open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        return rooted.join(open_, "key", "left_semi")

    left = written(unsettled(left, roots))
    slack = units.select("unit", "slack")
    todo = left.groupBy("unit").agg(F.count("*").alias("open")).join(slack, "unit").filter("open > slack").select("unit")
    todo = written(todo)
    if todo.isEmpty():
        return roots

    # Step 2: finer partition with one-deletion neighbourhoods, for these units.
    mine = sets.join(todo.select(_class("unit").alias("class")).distinct(), "class", "left_semi")
    near = mine.mapInArrow(lambda it: _neighbourhoods(it, percent),
                           "key long, unit long, segment long, deleted boolean, least long").join(todo, "unit", "left_semi")
    near = written(near)
    near = near.join(near.groupBy("key").agg(F.count("*").alias("c")), "key")
    value = near.groupBy("unit", "segment", "least").agg(
        (F.bool_and(F.col("c") <= LIMIT) & F.bool_or("deleted")).alias("all"), F.bool_or((F.col("c") <= LIMIT) & ~F.col("deleted")).alias("exact"))
    value = value.groupBy("unit", "least").agg(F.sum(F.when(F.col("all"), 2).when(F.col("exact"), 1).otherwise(0)).alias("v"))
    pairs = _pairs(near.filter(F.col("c") <= LIMIT), "deleted").filter("not (ex and ey)")
    links = _edges(roots).union(join.verified(join.similar_sizes(_as_classes(pairs)), sets))
    still = value.filter("v < least").select("unit")
    roots = written(components(links, "a", "b"))
    left = written(unsettled(left.select("key", "unit").join(still, "unit", "left_semi"), roots))
    if left.isEmpty():
        return roots

    # Step 3: across components, within the costly keys.
    links = _edges(roots).union(join.verified(_costly_pairs(left, sets, percent), sets))
    return components(links, "a", "b")


def _judged(docs: DataFrame, percent: int, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, key, n_shingles, component) of each row; no component without words."""
    join = _Join(docs, id_col, text_col, percent, size)
    roots = link_classes(join)
    classes = join.classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "rep", F.coalesce("root", "class").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("rep").alias("component"))
    found = classes.select("class", "root").join(lowest, "root").select("class", "component")
    return join.described.join(found, "class", "left").select("id", "key", "n_shingles", "component")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE) -> DataFrame:
    """One row per document: ``id_col``, n_shingles and component_id, the
    smallest id reachable over links (itself included)."""
    out = _judged(docs, percent, id_col, text_col, size)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, all columns kept: the text of the
    smallest id (of several under it, one). Rows go by id and text, so a text
    that is alone stays though its id has other rows; rows without id or
    words stay; of rows that repeat id and text one stays."""
    rows = written(_judged(docs, percent, id_col, text_col, SHINGLE).filter("id is not null"))
    low = rows.filter("id = component").groupBy("component").agg(F.min("key").alias("low"))
    drop = rows.join(low, "component").filter("id <> component or key <> low")
    drop = written(drop.select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct())
    same = F.col(id_col) == F.col("__id")
    of_text = F.xxhash64(F.col(text_col).cast("string")) == F.col("__key")
    kept = docs.join(bounded_broadcast(drop, MAX_BROADCAST), same & of_text, "left_anti")
    twice = written(rows.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).count().filter("count > 1").drop("count"))
    if twice.isEmpty():
        return kept
    twice = bounded_broadcast(twice, MAX_BROADCAST)
    return kept.join(twice, same & of_text, "left_anti").unionByName(kept.join(twice, same & of_text, "left_semi").dropDuplicates([id_col, text_col]))
