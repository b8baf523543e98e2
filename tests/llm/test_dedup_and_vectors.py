"""Circulant MinHash, whitening and hard negatives against brute force on
small tables with nulls, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import math
import random
import re

import pytest

from test_llm_operators import ODD, WORDS, frame, prose


# -- 12 --------------------------------------------------------------------

def components_by_hand(rows, size, percent):
    """{row index: (set size, smallest id reachable)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = {}
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[i] = (len(sets[i]), min(ids) if ids else own)
    return out


def family(rng, n, words, change):
    """``n`` texts that each differ from one text in some words."""
    base = prose(words, rng).split()
    return [" ".join(rng.choice(WORDS) if rng.random() < change else w for w in base) for _ in range(n)]


def test_minhash_components_equal_all_pairs(spark):
    from meterline.llm.circulant_minhash import near_duplicates

    rng = random.Random(12)
    texts = list(ODD)
    for n, words, change in [(30, 60, 0.02), (20, 200, 0.025), (12, 30, 0.01), (8, 1500, 0.02)]:
        texts += family(rng, n, words, change)
    passage = prose(70, rng)
    texts += [f"{prose(25, rng)} {passage} {prose(25, rng)}" for _ in range(25)]  # a shared passage is no link
    y = prose(40, rng).split()
    texts += [" ".join([rng.choice(WORDS), *y, rng.choice(WORDS)]) for _ in range(30)] + [" ".join(y)]
    texts += [texts[20].upper(), texts[20].replace(" ", " \t "), texts[21]]
    ids = [i * 3 % 1009 for i in range(len(texts))]
    ids[3], ids[25] = None, None
    rows = list(zip(ids, texts))
    rows += [rows[40], (rows[41][0], prose(9, rng))]  # one row twice, one id with two texts
    got = near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    want = components_by_hand(rows, 3, 85)
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == sorted(
        (str(rows[i][0]), n, root) for i, (n, root) in want.items())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({root for _, root in want.values()}) > 40


def test_minhash_large_keys_in_cells(spark, monkeypatch):
    """With a limit of two classes a key and cells of eight, keys are cut."""
    import meterline.llm.circulant_minhash as m

    monkeypatch.setattr(m, "LIMIT", 2)
    monkeypatch.setattr(m, "CELL", 8)
    rng = random.Random(13)
    passage = prose(260, rng)
    texts = [f"{passage} {prose(40, rng)}" for _ in range(40)]  # share 0.76 of all words, no links
    texts += family(rng, 60, 120, 0.03) + family(rng, 40, 90, 0.04)
    got = m.near_duplicates(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_by_hand(list(enumerate(texts)), 3, 85)


def test_minhash_without_rows_or_links(spark):
    from meterline.llm.circulant_minhash import near_duplicates

    docs = frame(spark, ["a b c d", None, "x", "x", "three words here"], [None, None, 5, None, 7])
    assert near_duplicates(docs.limit(0)).count() == 0
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == {(None, 2, None, True), (None, 0, None, True), (5, 1, 5, True), (None, 1, 5, False), (7, 1, 7, True)}


def test_circulant_signature_estimates_jaccard():
    import numpy as np

    from meterline.llm import circulant_minhash as m

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[300:2300])
    length = 480
    x, y = m.signature(a, length), m.signature(b, length)
    true = 1700 / 2300
    assert abs((x == y).mean() - true) < 4 * math.sqrt(true * (1 - true) / length)
    # Coordinate k: the smallest number k slots behind the places.
    ring = m._runs(length)[:, 0]
    places = (m._mix(a ^ np.uint64(m.SEEDS[0])) >> np.uint64(44)).astype(np.int64)
    assert all(x[k] == ring[(places + k) % m.PLACES].min() for k in (0, 1, 77, 479))
    assert sorted(ring.tolist()) == list(range(m.PLACES))
    assert (1 - 0.85**8) ** m.bands(85, 8) <= m.MISS and m.bands(100, 8) == 1
    least = m.least_equal(85, 464)
    tail = sum(math.comb(464, k) * 0.85**k * 0.15 ** (464 - k) for k in range(least))
    assert 330 < least < 394 and tail <= m.MISS and m.least_equal(100, 464) == 464


# -- 11 and 13 ---------------------------------------------------------------

EMBED = "vec_id long, embedding array<float>, label int, id string, v string, x string, w string, uid string, block string, a string"


def embed(spark, rows):
    return spark.createDataFrame([(i, v, label, *"idvxwuB"[:7]) for i, v, label in rows], EMBED)


def unit(rng, n):
    v = [rng.gauss(0, 1) for _ in range(n)]
    length = math.sqrt(sum(x * x for x in v))
    return [x / length for x in v]


def odd_rows(rng, dims):
    nan, inf = float("nan"), float("inf")
    return [(901, None, 1), (902, [], 1), (903, [nan] * dims, 2), (904, [0.1] * (dims - 1) + [None], 2), (905, [inf] + [0.1] * (dims - 1), 3),
            (906, [-inf] + [0.1] * (dims - 1), 3), (907, [0.5] * (dims - 1), 4), (None, unit(rng, dims), 1)]


def test_whitening_equals_numpy(spark):
    import numpy as np

    from meterline.llm.whitening import fit, integer_vectors, whiten_embeddings

    rng = random.Random(11)
    dims = 12
    rows = [(i, unit(rng, dims), i % 3) for i in range(300)] + odd_rows(rng, dims)
    rows += [rows[5], (7000, rows[6][1], 0)]
    good = [(i, v) for i, v, _ in rows if v and len(v) == dims and None not in v and all(math.isfinite(c) for c in v)]
    df = embed(spark, rows)
    got = whiten_embeddings(df).collect()
    x = np.floor(1024 * np.array([np.array(v, np.float32) for _, v in good], float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    cov = np.cov((x - x.mean(axis=0)).T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (x - x.mean(axis=0)) @ vectors[:, :8] / np.sqrt(values[:8])
    deviation = ((n * x - s) ** 2).sum(axis=1)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by = {}
    for r in got:
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    signs = {}
    for (i, _), d, w in zip(good, deviation.tolist(), want):
        found = by[i, d]
        for k in range(8):
            signs.setdefault(k, 1 if found[k + 1][0] * w[k] > 0 else -1)
            assert all(abs(signs[k] * c - w[k]) < 1e-9 for c in found[k + 1])
    assert len(by[rows[5][0], deviation[5]][1]) == 2  # a repeated row gives its rows again
    ints, d = integer_vectors(df)
    model = fit(ints, d)
    assert d == dims and model.sums == tuple(s.tolist()) and np.abs(np.array(model.covariance) - cov).max() < 1e-9 * cov.max()


def test_whitening_is_exact_far_from_zero(spark):
    """A tiny spread on a huge offset, and squares beyond 64 bits."""
    from fractions import Fraction

    from meterline.llm.whitening import fit

    far = [[(1 << 39) + i % 2, (1 << 39) + (i // 2) % 2, i] for i in range(64)] + [[1 << 39, 0, 5]]
    x = spark.createDataFrame([(i, v) for i, v in enumerate(far)], "id long, x array<long>")
    model = fit(x, 3)
    mean = [Fraction(sum(v[k] for v in far), 65) for k in range(3)]
    for i in range(3):
        for j in range(3):
            want = sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in far) / 65
            assert abs(Fraction(model.covariance[i][j]) - want) <= abs(want) * Fraction(1, 2**52)


def test_whitening_without_variance(spark):
    from meterline.llm.whitening import whiten_embeddings

    same = embed(spark, [(i, [0.25, -0.5, 0.125], 1) for i in range(5)])
    got = whiten_embeddings(same).collect()
    assert len(got) == 15 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    line = embed(spark, [(i, [0.25, i / 8, 0.5], 1) for i in range(5)])
    got = whiten_embeddings(line).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert all(r["explained"] == pytest.approx(float(r["component"] == 1)) for r in got)
    assert whiten_embeddings(embed(spark, [(1, [0.5, 0.25], 1)])).count() == 2
    empty = whiten_embeddings(same.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten_embeddings(embed(spark, [(1, None, 1), (2, [], 1)])).count() == 0


def negatives_by_hand(rows, dims, every=100):
    items = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows
             if label is not None and v and len(v) == dims and None not in v and all(math.isfinite(c) for c in v)]
    place = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i, v, label in items:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in items if j != i]
        positives = sorted(((s, j) for s, j, other in scored if other == label), key=place)[:5]
        for s, j in positives:
            found = sorted(((t, k) for t, k, other in scored if other != label and 80 * s <= 100 * t <= 100 * s), key=place)[:5]
            out += [(i, j, rank + 1, k, s, t) for rank, (t, k) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("dims,rows_a_cell,anchors_a_block", [(6, 8192, 4096), (64, 50, 3), (70, 8192, 4096)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dims, rows_a_cell, anchors_a_block):
    import numpy as np

    import meterline.llm.hard_negatives as m

    monkeypatch.setattr(m, "ROWS", rows_a_cell)
    monkeypatch.setattr(m, "ANCHORS", anchors_a_block)
    rng = random.Random(dims)
    centres = [unit(rng, dims) for _ in range(4)]
    near = lambda k, s: [float(np.float32(c + rng.gauss(0, s))) for c in centres[k]]
    rows = [(i, near(rng.randrange(4), rng.choice([0.02, 0.2])), rng.randrange(3)) for i in range(0, 1200, 4)]
    rows += odd_rows(rng, dims)[:-1] + [(None, near(0, 0.02), 0), (None, near(0, 0.02), 1), (910, near(1, 0.1), None)]
    rows += [(2000 + i, rows[3][1], i % 3) for i in range(12)]  # equal vectors: ties by id
    rows += [rows[7], rows[25], (3000, [0.0] * dims, 1), (3100, [-c for c in rows[0][1]], 2)]  # repeated rows, anchors among them
    got = sorted(map(tuple, m.mine(embed(spark, rows)).collect()), key=str)
    want = negatives_by_hand(rows, dims)
    assert got == want and len(want) > 100


def test_hard_negatives_without_partners(spark):
    from meterline.llm.hard_negatives import mine

    assert mine(embed(spark, [(0, [1.0, 0.0], 1)])).count() == 0
    assert mine(embed(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)])).count() == 0
    assert mine(embed(spark, [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-1.0, 0.0], 2)])).count() == 0  # an empty range
    some = embed(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, -1.0], 2), (3, [0.5, 0.0], 2)])
    assert list(map(tuple, mine(some).collect())) == [(0, 1, 1, 2, 0, 0)]
    assert mine(some.limit(0)).count() == 0 and mine(embed(spark, [(0, None, 1), (1, [], 2)])).count() == 0


def test_code_intervals_hold_the_true_product():
    import numpy as np
    import pyarrow as pa

    from meterline.llm import hard_negatives as m

    rng = np.random.default_rng(1)
    for dims in (3, 64, 130):
        v = np.floor(256 * rng.normal(size=(200, dims)) / np.sqrt(dims)).astype(np.int64)
        v[0] = 0
        turned = m.rotate(v)
        assert np.allclose(turned @ turned.T, v @ v.T)
        batch = pa.table({"uid": np.arange(200), "id": np.arange(200), "label": np.zeros(200, np.int64), "v": pa.array(v.tolist())})
        side = m._Side(pa.Table.from_batches(list(m._index(batch.to_batches(), dims))))
        low, high = m.intervals(side, side)
        true = v @ v.T
        assert (low <= true).all() and (true <= high).all()
        assert np.median(high - low) < 0.6 * np.median(side.norm) ** 2
