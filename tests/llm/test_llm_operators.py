"""Training-data operators against brute force on small tables with nulls,
empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import collections
import hashlib
import html
import random
import re
import zlib

import public_tokenizers
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, spans string, word string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abdeinorst") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def prose(n: int, rng=RNG) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", len(t or ""), "x", "y", "z", "w")
                                  for i, t in zip(ids, texts)], DOC)


ODD = [None, "", " \t\n ", "a", "Ünïcode ½ ﬁ 日本 \u2581 x\u0000y", "tab\there  two  spaces\r\nline", "<|endoftext|> mid <|endoftext|>",
       "it's we'll  'quoted'   end   ", prose(3000), "same text twice", "same text twice"]


# -- 1 ---------------------------------------------------------------------

def test_leaks_with_changed_slots(spark):
    from meterline.llm.decontaminate import find_leaks, remove_leaks

    items = spark.createDataFrame([
        (1, "In the shop young Tom bought 12 red apples and later Tom ate 4 of the 12 apples before dinner was ready"),
        (2, prose(30)), (3, None), (4, ""), (5, "only five words right here")], "item_id long, text string")
    texts = [
        "He said: In the shop young Anna bought 35 red apples and later Anna ate 9 of the 35 apples before dinner was ready.",
        "In the shop young Anna bought 35 red apples and later Karl ate 9 of the 77 apples before dinner was ready",
        "In the shop young Tom bought 12 red apples and later Tom ate 4 of the 12 apples before dinner was ready",
        "xx " + [r["text"] for r in items.collect()][1].upper() + "!! yy", prose(200), None, "", "so only five words, right here it is"]
    docs = frame(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in find_leaks(docs, items).collect()}
    assert got == {(0, 1): False, (2, 1): True, (3, 2): True, (7, 5): True}
    kept = remove_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_short_items_leak_as_whole_lines_only(spark):
    from meterline.llm.decontaminate import find_leaks, remove_leaks

    items = spark.createDataFrame([(1, "the"), (2, "How many?"), (3, "12 kg"), (4, "five words are found inside"), (4, "4.5"), (5, "...")],
                                  "item_id long, text string")
    texts = ["the cat sat on the mat", "The", "so how many are there\nHOW  MANY\nnobody knows", "it weighs 12 kg", "- 12 kg!\nand more",
             "that five words are found inside this", "4.5", "45 is not 4 5", None, "", prose(30)]
    got = sorted((r["doc_id"], r["item_id"], r["exact"]) for r in find_leaks(frame(spark, texts), items).collect())
    assert got == [(1, 1, True), (2, 2, True), (4, 3, True), (5, 4, True), (6, 4, True)]
    assert sorted(r["doc_id"] for r in remove_leaks(frame(spark, texts), items).collect()) == [0, 3, 7, 8, 9, 10]
    one = items.filter("item_id = 1")
    assert [r["doc_id"] for r in find_leaks(frame(spark, texts), one).collect()] == [1]


def test_numbers_units_and_names_are_slots(spark):
    """A question with every kind of slot, whole and changed, among texts with
    the same numbers in other places."""
    from meterline.llm.decontaminate import find_leaks

    ask = "A train with {a} wagons leaves {n} at noon and runs {b} km in {c} hours, how many {u} is {n} away when {a} wagons are gone"
    item = ask.format(a="12", b="1,500", c="three", n="Berlin", u="miles")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item, ask.format(a="15", b="2,300", c="5", n="Madrid", u="miles"), ask.format(a="15", b="2,300", c="5", n="Madrid", u="miles").replace("is Madrid", "is Oslo"),
             ask.format(a="twenty", b="900", c="9", n="Rome", u="miles"), item.upper(), prose(300) + " " + item + " " + prose(300) * 30,
             "12 km, 1,500 miles and three hours in Berlin"]
    got = {r["doc_id"]: r["exact"] for r in find_leaks(frame(spark, texts), items).collect()}
    assert got == {0: True, 1: False, 3: False, 4: True, 5: True}


def test_leaks_split_over_diagonals(spark):
    from meterline.llm.decontaminate import find_leaks

    rng = random.Random(21)
    short, long, slots = prose(20, rng).split(), prose(200, rng).split(), (prose(9, rng) + " 12 " + prose(9, rng) + " 12 " + prose(9, rng)).split()
    items = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long)), (3, " ".join(slots))], "item_id long, text string")
    around = lambda w: " ".join([prose(30, rng), *w, prose(30, rng)])
    texts = [around(short[:10] + ["qqq"] + short[10:]), around(short[:10] + short[11:]), around(short[:10] + ["qqq"] + short[11:]),
             around(short[:10] + prose(15, rng).split() + short[10:]), around(long[60:92]), around(long[60:90]), around(short[:12]),
             around(short[:9] + prose(200, rng).split() + short[11:]),
             around(["35" if w == "12" else w for w in slots[:14]] + ["qqq"] + ["35" if w == "12" else w for w in slots[14:]]),
             around(slots[:9] + ["35"] + slots[10:19] + ["36"] + slots[20:])]
    got = {(r["doc_id"], r["item_id"]): (r["exact"], r["n_windows"], r["need"]) for r in find_leaks(frame(spark, texts), items).collect()}
    assert got == {(0, 1): (True, 6, 13), (1, 1): (True, 5, 13), (2, 1): (True, 5, 13), (3, 1): (True, 6, 13), (4, 2): (True, 25, 193),
                   (8, 3): (False, 15, 22)}


def test_leaks_in_other_case_space_and_rows(spark):
    from meterline.llm.decontaminate import find_leaks, remove_leaks

    item = "In the shop young Tom bought 12 red apples and later Tom ate 4 of the 12 apples before dinner was ready"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    changed = item.replace("Tom", "Anna").replace("12", "35")
    texts = [item.lower(), item.upper(), item.title(), item.replace(" Tom", "\nTom"), changed.replace(" ", "  "), item.replace(" ", "\u00a0\t"),
             item.replace("Tom ate", "Karl ate"), changed, prose(40), prose(40), changed, item]
    ids = [0, 1, 2, 3, 4, 5, 6, None, None, 9, 9, 11]
    docs = frame(spark, texts, ids)
    got = {r["doc_id"]: r["exact"] for r in find_leaks(docs, items).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: True, None: False, 9: False, 11: True}
    assert sorted(r["text"] for r in remove_leaks(docs, items).collect()) == sorted([texts[6], texts[8], texts[9]])


# -- 2 ---------------------------------------------------------------------

def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    from meterline.llm.token_counts import count_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = ODD + ["".join(chr(rng.choice([32, 10, 39, 48, 65, 97, 233, 0x416, 0x2019, 0x4E2D, 0x1F600])) for _ in range(rng.randint(1, 60)))
                   for _ in range(200)] + ["common word " * 9] * 40
    docs = frame(spark, texts, [None, *range(1, len(texts))])
    tok = Tokenizer.from_file(path)
    want = collections.Counter((i if i else None, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids))
                               for i, t in enumerate(texts))
    rows = count_tokens(docs, path).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert count_tokens(docs.limit(0), path).count() == 0


# -- 3 ---------------------------------------------------------------------

KINDS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8, 2),
         ("access", re.compile("AKIA[A-Z0-9]+"), 16, 0), ("hex", re.compile("[0-9a-f]+"), 32, 0)]


def base(text):
    return sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, least, g) in enumerate(KINDS)
                  for m in p.finditer(text or "") if len(m.group(g)) >= least)


def test_secret_spans_equal_brute_force(spark):
    from meterline.llm.secret_scan import redact, scan_secrets

    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    texts = ODD + ["😀 é PASSWORD: 'abc' token=12345678 and api_key = \"" + hexes[0] + "\" AKIAABCDEFGHIJKL12 AKIA12",
                   "\ufdd0 secret=tooshort1 \ufdd1 passwd:short", "AKIA" + "A" * 40 + " " + "ab" * 20, "0123456789abcdef" * 4,
                   "token=" + hexes[1] + " " + hexes[1]] + [prose(20) + " " + h + " " + prose(5) for h in hexes] * 3
    docs = frame(spark, texts)
    for r in scan_secrets(docs).collect():
        want = base(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w[1] == k for w in want) for k in range(3)]
        joined = ",".join(w[2] for w in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == [w[2] for w in want]
        assert all("random" not in s for s in spans) or re.search("[0-9a-f]{32}", texts[r["doc_id"]])
    assert sum("random:" in r["spans"] for r in scan_secrets(docs).collect()) >= 100
    clean = redact(docs)
    assert clean.columns == [*docs.columns, "n_spans"]
    out = {r["doc_id"]: r for r in clean.collect()}
    assert out[len(ODD) + 4]["text"] == "[SECRET] [SECRET]" and out[0]["text"] is None and out[8]["text"] == texts[8]
    assert not any(h in (r["text"] or "") for r in out.values() for h in hexes)
    assert scan_secrets(docs.limit(0)).count() == 0


# -- 4 ---------------------------------------------------------------------

def test_urls(spark):
    from meterline.llm.queries import URL_RULES
    from meterline.llm.url_filter import judge_urls, viterbi

    assert viterbi("cheappills", [(0, 5, -3.0), (5, 5, -3.0)]) == ["cheap", "pills"]
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/de/", "x://b.net", "ftp://net/", "http://www.example.com/de/1#f",
            "http://example.com/de", "http://o.org/fr/", "nothing", None, "", "http://casinowin.test.example.com/en/"]
    urls += ["http://casino.example.com/en/", "http://casino-bets.example.com/en/", "http://plainly.example.com/en/a"] * 20
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in judge_urls(pages, URL_RULES).collect()}
    want = [("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"), ("b.net", "", None, None),
            ("net", "/", "net/", "block"), ("www.example.com", "/de/1", "example.com/de/", "block"), ("example.com", "/de", None, None),
            ("o.org", "/fr/", "org/fr/", "allow"), ("", "", None, None), ("", "", None, None), ("", "", None, None)]
    for i, (host, path, rule, verdict) in enumerate(want):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
    assert len(got) == len(urls) and got[10]["verdict"] == "block" and got[11]["verdict"] == "block" and got[13]["verdict"] == "allow"
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


# -- 5 ---------------------------------------------------------------------

def test_toxicity_held_out(spark):
    from meterline.llm.toxicity import keep_clean, score_toxicity

    rng = random.Random(3)
    texts, y = [], []
    for _ in range(900):
        toxic = rng.random() < 0.2
        words = prose(40, rng).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["idiot", "zorg" + rng.choice(WORDS), "moron"])
            words[rng.randrange(40)] = rng.choice(["idiot", "zorg" + rng.choice(WORDS), "moron"])
        texts.append(" ".join(words))
        y.append(int(toxic))
    docs = frame(spark, texts + ODD, [*range(900), None, *range(900, 899 + len(ODD))])
    labels = spark.createDataFrame([*enumerate(y), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held) and len(held) > 200
    assert sum(r["predicted"] != y[r["doc_id"]] for r in held) <= 0.02 * len(held)
    kept = keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}


# -- 6 ---------------------------------------------------------------------

def test_quality_counts_equal_brute_force(spark):
    from meterline.llm.quality_rules import judge_quality

    line = prose(12)
    texts = ODD + [f"{line}\n{line}\n{prose(30)}\n\n \n{line}", " ".join([line] * 6), "#$ %% <|> " * 30, prose(60)] + [prose(80) for _ in range(60)]
    rows = {r["doc_id"]: r for r in judge_quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        seen = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = rows[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert all(rows[i]["kept"] for i in range(len(texts) - 61, len(texts))) and not rows[len(ODD) + 2]["kept"]
    assert judge_quality(frame(spark, texts).limit(0)).count() == 0


# -- 7 ---------------------------------------------------------------------

def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4))


def test_jaccard_components_equal_brute_force(spark):
    from meterline.llm.jaccard_join import keep_one, near_duplicates

    rng = random.Random(9)

    def changed(text, k):
        w = text.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        return " ".join(w)

    texts = list(ODD)
    passage = prose(60, rng)
    for n in (3, 5, 6, 9, 14, 25, 40, 90, 300, 700):
        seed = prose(n, rng)
        texts += [seed, seed.upper(), changed(seed, 1), changed(seed, max(1, n // 40)), changed(seed, n // 10 + 1)]
    hub = prose(150, rng)
    texts += [changed(hub, rng.randint(1, 4)) for _ in range(60)]           # a large group of near copies
    texts += [f"{prose(rng.randint(4, 60), rng)} {passage} {prose(5, rng)}" for _ in range(60)]  # a shared passage
    ids = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    root = list(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in ids:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = frame(spark, texts, ids)
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in ids} == {i: (len(sets[i]), find(i)) for i in ids}
    again = docs.unionByName(frame(spark, [texts[-1], None, texts[0]], [ids[-1], None, None]))
    kept = keep_one(again)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*{str(find(i)) for i in ids}, "None", "None"])
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [1024, 7])
def test_costly_keys_meet_every_link(spark, monkeypatch, cell):
    from pyspark.sql import functions as F

    import meterline.llm.jaccard_join as m

    monkeypatch.setattr(m, "CELL", cell)
    rng = random.Random(5)
    passage = prose(60, rng)
    texts = [f"{passage} {prose(rng.choice([3, 6, 9, 12, 40]), rng)}" for _ in range(40)]
    for k in range(40):
        w = rng.choice(texts).split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w[:len(w) - k % 5]))
    texts = sorted(set(texts))
    sets = [shingles(t) for t in texts]
    want = {(j, i) for i in range(len(texts)) for j in range(i)
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    join = m._Join(frame(spark, texts), "doc_id", "text", 80, 5)
    found = join.sets(join.classes.select("class"))
    units = join.classes.select((2 * F.col("class")).alias("unit"), F.col("class").alias("root"))
    left = units.withColumn("key", F.explode(F.array(F.lit(3), F.lit(8)).cast("array<long>"))).select("key", "unit", "root")
    pairs = m._costly_pairs(left, found, 80)
    ids = {r["class"]: r["rep"] for r in join.classes.collect()}
    pair = lambda r: tuple(sorted((ids[r["a"]], ids[r["b"]])))
    met = [pair(r) for r in pairs.collect()]
    assert len(ids) == len(texts) and want <= set(met) and len(met) < 3 * len(want)
    assert want and {pair(r) for r in join.verified(pairs, found).collect()} == want


def test_large_group_of_near_copies_of_many_components(spark, monkeypatch):
    """Copies of one text that are changed so much that most are not similar
    to each other, and a hub that is."""
    import meterline.llm.jaccard_join as m

    monkeypatch.setattr(m, "CELL", 16)
    rng = random.Random(31)
    base = prose(120, rng).split()
    texts = [" ".join(rng.choice(WORDS) if rng.random() < rate else w for w in base) for rate in (0.0, 0.01, 0.02, 0.03) for _ in range(50)]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 20


def test_keep_one_goes_by_id_and_text(spark):
    from meterline.llm.jaccard_join import keep_one

    a, b, c, d = (prose(40) for _ in range(4))
    rows = [(3, a), (9, a), (9, b), (12, c), (12, c), (15, d), (15, d + " end"), (None, a), (20, None), (20, "")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = [(r["doc_id"], r["text"]) for r in keep_one(docs).collect()]
    assert len(kept) == 7 and [i for i, _ in kept].count(15) == 1
    assert {x for x in kept if x[0] != 15} == {(3, a), (9, b), (12, c), (None, a), (20, None), (20, "")}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6])
def test_slices_of_few_words(n):
    import pyarrow as pa

    from meterline.llm.jaccard_join import shingle_sets

    text = " ".join(WORDS[:n])
    alone = [len(s) for s in shingle_sets(pa.array([None, text, ""]), 5)]
    assert alone == [0, len(shingles(text)), 0]
    among = list(shingle_sets(pa.array([text, " ".join(WORDS[:40])]), 5))[0]
    assert list(shingle_sets(pa.array([text]), 5))[0].tolist() == among.tolist()


def test_single_shingle_segments_lose_no_link(spark):
    from meterline.llm.jaccard_join import near_duplicates

    rng = random.Random(26)
    hub = prose(13, rng)  # its 30 partners are too far from each other
    texts = [hub] + [f"{hub} {prose(2, rng)}" for _ in range(30)]
    assert {r["component_id"] for r in near_duplicates(frame(spark, texts)).collect()} == {0}


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_bands_and_segments_hold_every_pair(percent):
    from meterline.llm.jaccard_join import bands, differences, roles

    lows = bands(percent, 5000)
    for n in (1, 2, 3, 4, 5, 7, 20, 99, 100, 1000):
        (band, m0, least0), (up, m1, least1) = roles(n, lows, percent)
        assert lows[band] <= n < lows[band + 1] and up == band + 1
        for other in range(n, n * 100 // percent + 1):
            need = differences(n, other, percent) + 1
            assert other < lows[band + 2]
            assert (need <= least0 <= m0) if other < lows[band + 1] else (need <= least1)


# -- 8 ---------------------------------------------------------------------

def test_sentencepiece_round_trip_and_library(spark):
    import sentencepiece

    from meterline.llm.sentencepiece_codec import Codec, decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ODD + [prose(50) for _ in range(20)] + ["x" * 500, "▁▁", "a ▁ b", " lead", "trail "]
    docs = frame(spark, texts)
    plain = {r["doc_id"]: r for r in encode(docs, path, rate=0.0, variants=1).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, t in enumerate(texts):
        if "\u2581" not in (t or ""):
            assert plain[i]["ids"] == sp.encode(t or ""), i
    dropped = encode(docs, path, rate=0.3, seed=7)
    rows = {r["doc_id"]: r for r in dropped.collect()}
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in rows.values())
    assert sum(r["n_pieces"] for r in rows.values()) > sum(r["n_pieces"] for r in plain.values())
    assert {r["doc_id"]: r["text"] for r in decode(dropped, path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert [r["ids"] for r in encode(docs, path, rate=0.3, seed=7).orderBy("doc_id").collect()] == [rows[i]["ids"] for i in range(len(texts))]
    assert any(r["ids"] != rows[r["doc_id"]]["ids"] for r in encode(docs, path, rate=0.3, seed=8).collect())
    codec = Codec(open(path, "rb").read(), 0.3, 1)
    assert all(codec._merge_short(list(w), 12345) == codec._merge_long(list(w), 12345) for w in map(lambda w: "▁" + w, WORDS[:300]))
    assert encode(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_chunks_side_by_side_equal_one_by_one(rate):
    import public_tokenizers

    from meterline.llm.sentencepiece_codec import Codec

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        codec = Codec(f.read(), rate, seed=3)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aeiounrstlm  dé") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += ["", " ", "a\u2581b \u2581\u2581 c", "\u2581", "日本語 🙂 ok", "x" * 300 + " " + "ab" * 40]
    variants = [rng.randrange(3) for _ in texts]
    cache: dict = {}
    for text, variant, ids in zip(texts, variants, codec.encode_many(texts, variants, cache)):
        got = memoryview(ids).cast("i").tolist()
        assert got == [i for c in codec._chunked(text) for i in codec.chunk_ids(c, variant)]
        assert not text or codec.decode(got) == text


# -- 9 ---------------------------------------------------------------------

def test_fixity_audit_finds_the_damage(spark):
    from meterline.llm.warc_fixity import audit, replica

    rows = [(i, f"http://h/{i}", f"body {i} é" * (i % 7), "x") for i in range(2500)] + [(None, None, None, "x"), (7, "http://h/7", "again", "x")]
    schema = "page_id long, url string, html string, file string"
    hurt = [(i, u, (b or "") + "~" if i in (0, 3, 1024, 2499) else b, x) for i, u, b, x in rows]
    a, b = replica(spark.createDataFrame(rows, schema)), replica(spark.createDataFrame(hurt, schema))
    assert audit(a, a).count() == 0
    assert sorted((r["id"], r["finding"]) for r in audit(a, b).collect()) == [(i, "changed") for i in (0, 3, 1024, 2499)]
    short = replica(spark.createDataFrame(rows, schema).filter("page_id < 2400 or page_id is null"))
    lost = audit(a, short).collect()
    assert {r["finding"] for r in lost} == {"missing"} and sorted(r["id"] for r in lost) == list(range(2400, 2500))
    assert {r["finding"] for r in audit(short, a).collect()} == {"extra"}
    assert audit(a.limit(0), b.limit(0)).count() == 0 and audit(a.limit(0), b).count() == len(rows)


def test_fixity_audit_locates_lost_and_added_records(spark):
    from meterline.llm.warc_fixity import aged, audit, replica

    schema = "page_id long, url string, html string"
    rows = [(i, f"http://h/{i}", f"body {i}") for i in range(2500) if i != 50]
    rows += [(None, None, f"null {i}") for i in range(300)] + [(7, "u", f"again {i}") for i in range(300)] + [(8, "u", "same")] * 50
    a = replica(spark.createDataFrame(rows, schema)).cache()
    assert a.agg({"copies": "sum"}).first()[0] == len(rows) and a.groupBy("file").count().filter("count > 1024").count() == 0
    assert a.filter("id is null or id = 7").select("file").distinct().count() > 300
    hurt = [r for r in rows if r[0] not in (5, 1500) and r[2] not in ("null 3", "again 4")]
    hurt.remove((8, "u", "same"))
    hurt = [(i, u, "other" if i == 900 else b) for i, u, b in hurt] + [(50, "u", "new"), (9, "http://h/9", "second")]
    found = audit(a, replica(spark.createDataFrame(hurt, schema))).collect()
    assert sorted((str(r["id"]), r["finding"]) for r in found) == sorted([
        ("5", "missing"), ("1500", "missing"), ("None", "missing"), ("7", "missing"), ("8", "missing"), ("900", "changed"), ("50", "extra"), ("9", "extra")])
    pages = spark.createDataFrame(rows[:2000], schema)
    assert {r["finding"] for r in audit(replica(pages), replica(aged(pages))).collect()} == {"changed", "missing", "extra"}


# -- 10 --------------------------------------------------------------------

def page(k: int, host: str) -> tuple:
    body = [f"Title {k} &amp; more", f"First  <b>bold</b>word {k}", f"second &lt;tag&gt; &eacute; {k}", "same last line"][:3 + k % 2]
    text = " ".join(" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in body)
    ps = "".join(f"<p>{b}" + ("</p>" if k % 3 else "") for b in body[1:])
    return (f"http://{host}/{k}", f"<!DOCTYPE html><html><head><title>T{k}</title><script>if (a</p>b) '<p>no'</script><style>p{{}}</style></head>"
            f"<body><nav><ul>{'<li><a href=x>m</a></li>' * (k % 4 + 1)}</ul></nav><div class='ad-box ad'>Buy</div><div id=cookie-notice>ok</div>"
            f"<article><h1>{body[0]}</h1>{ps}<div class=\"comments\"><p>reader {k}</p></div><form>mail <input></form></article>"
            f"<aside>side</aside><footer>&copy; {host}</footer></body></html>", text)


def test_main_text(spark):
    from meterline.llm.html_wrappers import extract_main_text, infer_wrappers

    made = [page(k, f"h{k % 3}.example.org") for k in range(30)]
    rows = [(k, u, h, "x", "y") for k, (u, h, _) in enumerate(made)]
    rows += [(100, None, made[0][1], "x", "y"), (101, "http://z/", None, "x", "y"), (102, "http://z/", "", "x", "y"),
             (103, "http://q/", "<div><p>plain  text</p><ul><li><a>link</a></li></ul>cut off <b", "x", "y"),
             (0, made[0][0], made[0][1], "x", "y"), (104, "http://y/", "a < b and " + "w " * 20000, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, paths string")
    got = collections.defaultdict(list)
    for r in extract_main_text(pages).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    for k, (_, _, text) in enumerate(made):
        assert set(got[k]) == {text}, k
    assert len(got[0]) == 2 and got[100] == [made[0][2]] and got[101] == got[102] == [""]
    assert got[103] == ["plain text cut off"] and got[104][0].startswith("a < b and w w")
    w = {r["host"]: r["wrapper"] for r in infer_wrappers(pages).collect()}
    assert "(<li>#a</li>)+" in re.sub("'m'", "#a", w["h0.example.org"]) or ")+" in w["h0.example.org"]
    assert extract_main_text(pages.limit(0)).count() == 0


def main_texts(spark, pages):
    from meterline.llm.html_wrappers import extract_main_text

    rows = [(k, f"http://{host}/{k}", h) for k, (host, h) in enumerate(pages)]
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def test_main_text_of_two_templates_on_a_host(spark):
    frame_of = "<html><body><nav><a>menu</a></nav>{}<footer>end</footer></body></html>"
    pages = [("h", frame_of.format(f"<article><h1>Title {k}</h1><p>text {k}</p></article>") if k % 3 else
              frame_of.format(f"<div><p>plain {k}</p></div><pre>Subscribe now</pre>")) for k in range(60)]
    assert main_texts(spark, pages) == [f"Title {k} text {k}" if k % 3 else f"plain {k}" for k in range(60)]


def test_main_text_of_copies(spark):
    made = lambda k: f"<html><body><div><h1>Title {k}</h1><p>text {k}</p></div><pre>Same</pre></body></html>"
    pages = [("mirror", made(1)), ("mirror", made(1)), ("one", made(1))] + [("hot", made(0))] * 40 + [("hot", made(2)), ("hot", made(3))]
    want = ["Title 1 text 1 Same"] * 3 + ["Title 0 text 0"] * 40 + ["Title 2 text 2", "Title 3 text 3"]
    assert main_texts(spark, pages) == want


# -- pipeline --------------------------------------------------------------

def test_pipeline_on_small_tables(spark):
    import corpus_pipeline
    from meterline.session import table

    sf = "/root/testdata/sf0.001"
    docs, before = table(spark, sf, "documents"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema], name
        before, docs = docs, spark.createDataFrame(after.collect(), after.schema)
        ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.8 * len(ids), name
        if name == "near_duplicates":
            sets = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
            assert not any(s and t and 100 * len(s & t) >= 80 * len(s | t) for k, (_, s) in enumerate(sets) for _, t in sets[:k])
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == kept and all(r["lossless"] for r in out)


# -- more of 4 and 5 ---------------------------------------------------------

def test_viterbi_equals_all_splits_and_is_linear():
    import time

    from meterline.llm.url_filter import UNKNOWN, viterbi

    rng = random.Random(6)
    for _ in range(300):
        run = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        words = {run[i:j]: -rng.randint(1, 60) / 4 for i in range(len(run)) for j in range(i + 3, len(run) + 1) if rng.random() < 0.4}
        found = [(i, len(w), p) for w, p in words.items() for i in range(len(run)) if run.startswith(w, i)]
        cost = lambda w: max(words.get(w, -1e9), UNKNOWN[0] + UNKNOWN[1] * len(w))
        splits = [[run[a:b] for a, b in zip(cut, cut[1:])] for k in range(2 ** (len(run) - 1))
                  for cut in [[0, *(i + 1 for i in range(len(run) - 1) if k >> i & 1), len(run)]]]
        got = viterbi(run, found)
        assert "".join(got) == run and sum(map(cost, got)) == pytest.approx(max(sum(map(cost, x)) for x in splits))
    start = time.time()
    assert "".join(viterbi("x" * 50_000, [(5, 4, -1.0)])) == "x" * 50_000 and time.time() - start < 5


def test_long_labels_and_missing_ids(spark):
    from meterline.llm.queries import URL_RULES
    from meterline.llm.url_filter import judge_urls

    long = "http://" + "pokerfarm" * 2000 + ".com/" + "a-b/" * 5000
    rows = [(None, "http://a.net/x"), (1, long), (1, long), (2, "http://x.example.net/en/"), (3, "")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert len(got) == 5 and {(r["page_id"], r["rule"], r["verdict"]) for r in got if r["page_id"] in (None, 2)} == {
        (None, "net/", "block"), (2, "example.net/en/", "allow")}


def test_one_row_per_id_and_one_class(spark):
    from meterline.llm.toxicity import score_toxicity, training_rows

    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    hot = ids[0]
    docs = frame(spark, [f"text {i % 7} of many" for i in range(500)] + [prose(5) for _ in ids[1:]], [hot] * 500 + ids[1:])
    labels = spark.createDataFrame([(i, 1, 1) for i in ids], "doc_id long, quality int, toxic int")
    rows = training_rows(docs, labels, "doc_id", "text", "toxic").collect()
    assert len(rows) == len(ids) and {r["y"] for r in rows} == {1}
    assert {(r["score"], r["predicted"]) for r in score_toxicity(docs, labels).collect()} == {(0.5, 0)}


# -- more of 10 --------------------------------------------------------------

def test_constants_of_a_host_leave_its_articles(spark):
    """Notices, bios and share lines inside articles, as plain blocks without
    telling names, are found as constants of the host's wrapper."""
    from meterline.llm.html_wrappers import extract_main_text, infer_wrappers, main_text

    rng = random.Random(40)
    plain = lambda n: prose(n, rng)
    want, rows = {}, []
    for i in range(40):
        title, body = plain(4), [plain(30) for _ in range(rng.randint(1, 6))]
        noise = "<p>Note: we moved</p>" * (i != 7)                       # one page lacks it
        comments = f"<section id=responses><p>{plain(12)}</p></section>"
        page = (f"<html><body><article><h1>{title}</h1>{noise}" + "".join(f"<p>{b}</p>" for b in body) +
                f"<div>Written by  the desk</div><p>Share this &amp; more</p>{comments}</article></body></html>")
        want[i] = " ".join([title, *body])
        rows.append((i, f"http://one.example/{i}", page))
    near = [plain(30) for _ in range(5)]
    for i in range(40, 60):                                              # near copies are no template
        body = [*near, plain(5)]
        want[i] = " ".join(body)
        rows.append((i, f"http://near.example/{i}", "<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>"))
    for i in range(60, 63):                                              # three pages prove nothing
        body = plain(40)
        want[i] = f"Same line {body}"
        rows.append((i, f"http://few.example/{i}", f"<article><p>Same line</p><p>{body}</p></article>"))
    copies = f"<article><p>{plain(20)}</p><p>Same line</p></article>"
    rows += [(63 + i, f"http://one.example/copy{i}", copies) for i in range(3)]
    want |= {63 + i: main_text(copies, {}) for i in range(3)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    assert got == want
    off = {i: main_text(page, {}) for i, _, page in rows}
    assert sum(off[i] != got[i] for i in range(40)) == 40
    found = {r["host"]: {x["text"] for x in r["constants"]} for r in infer_wrappers(pages.filter("page_id < 63")).collect()}
    assert found["near.example"] == set() and found["few.example"] == set() and "Written by the desk" in found["one.example"]


def test_wrappers_are_of_all_pages(spark):
    """A path that two pages of many have, and a block that most have and a
    few lack, are in the wrapper and judged, wherever the pages stand."""
    from meterline.llm.html_wrappers import extract_main_text, infer_wrappers

    rng, rows, want = random.Random(41), [], []
    for k in range(400):
        note = "<p>Send corrections here</p>" * (k % 20 > 0)
        seldom = "<section><dl><dd>Seldom line</dd></dl></section>" * (k in (123, 321))
        title, body = prose(4, rng), prose(40, rng)
        rows.append((k, f"http://a.example/{k}", f"<article><h1>{title}</h1>{note}<p>{body}</p></article>"))
        want.append(f"{title} {body}")
        rows.append((400 + k, f"http://b.example/{k}", f"<body><div><h1>{title}</h1><p>{body}</p></div>{seldom}</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    found = {r["host"]: r for r in infer_wrappers(pages).collect()}
    assert {x["text"] for x in found["a.example"]["constants"]} == {"Send corrections here"}
    assert any("section/dl/dd" in p for p in found["b.example"]["paths"])
    assert sorted(r["text"] for r in extract_main_text(pages).collect()) == sorted(want * 2)


# -- more of the pipeline ------------------------------------------------------

def test_pipeline_with_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and ids, extra columns of names that
    the stages use, and no rows at all."""
    import corpus_pipeline
    from meterline.llm.sentencepiece_codec import decode

    a, b, item = prose(60), prose(60), prose(30)
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (4, None), (5, ""), (6, f"x {item} y"), (7, f"password: hunter2hunter2 {prose(20)}")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    for name, df in (("full", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "full" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        (bench if name == "full" else bench.limit(0)).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full")
    got = out.collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "4", "5", "7", "None"] and all(r["lossless"] for r in got)
    texts = {r["doc_id"]: r["text"] for r in decode(out, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert texts[2] == b and texts[None] == a and "hunter2" not in texts[7] and texts[4] == ""
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


# -- more of 5 ---------------------------------------------------------------

def test_toxicity_keeps_few_words(monkeypatch):
    """What a worker keeps of words is bounded and no part of the result."""
    from meterline.llm import toxicity as X

    monkeypatch.setattr(X, "KEPT_WORDS", 50)
    monkeypatch.setattr(X, "KEPT_FEATURES", 20)
    of, made = X._Fired({"w:idiot": 7, "p:idi": 8}), X._Features()
    for i in range(1000):
        assert of[f"word{i}"] == () and made[f"word{i}"] == X.features(f"word{i}")
        assert tuple(of["idiot"]) == (7, 8) and len(of) <= 51 and len(made) <= 21
    assert len(vars(of)) == 1  # the voters; no second cache beside it


@pytest.mark.parametrize("rate", [0.0, 0.3])
def test_sentencepiece_works_out_odd_characters_side_by_side(rate, monkeypatch):
    import random

    import numpy as np
    import public_tokenizers

    from meterline.llm.sentencepiece_codec import MANY, Codec

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        codec = Codec(f.read(), rate, seed=3)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abeht\nЀ€漢😀éß\x00▁ ") for _ in range(rng.randrange(40))) for _ in range(400)]
    variants = [i % 3 for i in range(len(texts))]
    want = [[i for c in codec._chunked(t) for i in codec.chunk_ids(c, v)] for t, v in zip(texts, variants)]
    alone, one = [], Codec.chunk_ids
    monkeypatch.setattr(Codec, "chunk_ids", lambda self, chunk, v: alone.append(chunk) or one(self, chunk, v))
    got = codec.encode_many(texts, variants, {})
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == want
    per = {}
    for c in alone:
        per[len(c)] = per.get(len(c), 0) + 1
    assert all(n < MANY or k < 2 for k, n in per.items())   # as many of a length as are worth it go together
    lens = np.array([len(w) for w in want])
    assert codec.decode_many(np.frombuffer(b"".join(got), np.int32), lens) == texts
    assert codec.decode_many(np.zeros(0, np.int32), np.zeros(2, int)) == ["", ""]
