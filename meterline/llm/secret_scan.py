"""Operator 3: secret scan. DataFrame functions only.

Base spans: leftmost non-overlapping matches of three patterns in the whole
text, those that are too short dropped (``KINDS``).

Method spans: letter/digit runs that look random. Each run of at least
``MIN_RUN`` characters gets the smallest encoding that holds it (digits, hex,
base32, base64) and a battery of tests over the encoding's symbol numbers:

* chi-squared distance from a uniform alphabet. Ordinary writing is far from
  uniform: its expected value grows with the length, by the index of
  coincidence of the encoding's ordinary use (``ENCODINGS``). The evidence
  against "ordinary writing" is how far the value lies below that mean, so
  the same unevenness counts for more in a longer run;
* a runs test above/below the middle of the alphabet and a lag-1 serial
  correlation test. A run that fails one of them (|z| > ``MAX_Z``) is a
  sequence or a pattern ("abcdef...", "0101..."), not a secret.

False discovery control is length-aware: the evidence is binned per stratum
(encoding, length band), the bins are counted over all documents, and within
each stratum Benjamini-Hochberg takes the largest set of runs whose expected
share of ordinary ones is at most ``FDR``. The counts are a histogram of at
most ``BINS`` bins per stratum, however many documents there are; the limits
come back as one small map.

Positions are code points (end exclusive). They are found by setting a
noncharacter around each match and adding up the pieces' lengths; texts that
hold that noncharacter themselves are searched with another character in its
place, which no pattern can match and which keeps every position.

Defined results: null text has no spans; base_sha256 of none is that of the
empty string; repeated rows each give a row; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind, pattern, text that a match must have for the document to be searched.
KINDS = [("assign", ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
LEAST = {"assign": 8, "access": 16, "hex": 32}
QUICK = {"assign": ASSIGN[:-2] + "{8})", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
MARK, OTHER = "﷐", "﷑"

MIN_RUN = 20
RUN = "[A-Za-z0-9+/_-]{20,}={0,2}"
MAX_Z = 3.3
FDR = 0.01
BINS = 400
# name, symbols, index of coincidence of ordinary writing in these symbols
# (fixed values: about 0.066 for Latin letters, 0.17 for words of a-f).
ENCODINGS = [
    ("digits", "0123456789", 0.25),
    ("hex", "0123456789abcdef", 0.17),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.066),
]


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, found)."""
    clean = F.translate(text, MARK, OTHER)
    pieces = F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"),
                     F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["out"], F.array(
            F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("found"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


NO_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start, then kind as listed."""
    def of(rank: int, kind: str, pattern: str) -> Column:
        value = (lambda m: F.regexp_extract(m["found"], ASSIGN, 2)) if kind == "assign" else (lambda m: m["found"])
        kept = F.filter(matches(text, pattern), lambda m: F.length(value(m)) >= LEAST[kind])
        spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"),
                                                     F.lit(kind).alias("kind"), m["end"].alias("end")))
        # A cheap search first: most texts hold no match of the full length.
        return F.when(text.rlike(QUICK[kind]), spans).otherwise(F.array().cast(NO_SPANS))
    return F.sort_array(F.concat(*[of(i, k, p) for i, (k, p) in enumerate(KINDS)]))


def _battery(run: Column) -> Column:
    """Struct (enc, band, bin, random) of a run: see the module text."""
    body = F.translate(F.regexp_replace(run, "=+$", ""), "-_", "+/")

    def tested(name: str, symbols: str, ic: float) -> Column:
        k = len(symbols)

        def given(raw: Column) -> Column:
            s = F.lower(raw) if name == "hex" else raw
            n = F.length(s).cast("double")
            numbers = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(symbols), c) - 1)

            def stats(x: Column) -> Column:
                counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.size(F.filter(x, lambda v: v == j)))
                squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
                chi2 = squares * k / n - n
                # Mean and variance of the statistic for ordinary writing.
                shift = (n - 1) * (k * ic - 1)
                z = ((k - 1) + shift - chi2) / F.sqrt(2 * ((k - 1) + 2 * shift))
                high = F.transform(x, lambda v: (v >= k // 2).cast("int"))
                n1 = F.aggregate(high, F.lit(0), lambda a, v: a + v).cast("double")
                n0 = n - n1
                turns = F.aggregate(F.zip_with(F.slice(high, F.lit(2), F.size(high)), high, lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0))),
                                    F.lit(0), lambda a, v: a + v) + 1
                mean = 2 * n0 * n1 / n + 1
                var = (mean - 1) * (mean - 2) / (n - 1)
                z_runs = F.when(var > 0, F.abs(turns - mean) / F.sqrt(var)).otherwise(F.lit(99.0))
                avg = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
                ss = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - avg) * (v - avg))
                lag = F.aggregate(F.zip_with(F.slice(x, F.lit(2), F.size(x)), x, lambda a, b: F.coalesce((a - avg) * (b - avg), F.lit(0.0))),
                                  F.lit(0.0), lambda a, v: a + v)
                z_lag = F.when(ss > 0, F.abs(lag / ss + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
                # -10 log10 of the normal upper tail (its usual bound), as a bin.
                tail = F.when(z > 1, 10 * (z * z / 2 + F.log(z * math.sqrt(2 * math.pi))) / math.log(10)).otherwise(F.lit(0.0))
                return F.struct(F.lit(name).alias("enc"), F.floor(F.log2(n)).cast("int").alias("band"),
                                F.least(F.floor(tail), F.lit(BINS)).cast("int").alias("bin"),
                                ((z_runs <= MAX_Z) & (z_lag <= MAX_Z)).alias("random"))
            return bind(numbers, stats)
        return bind(body, given)

    d, h, b, r = (tested(*e) for e in ENCODINGS)
    return (F.when(body.rlike("^[0-9]+$"), d).when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), h)
            .when(body.rlike("^[A-Z2-7]+$"), b).otherwise(r))


def candidates(text: Column) -> Column:
    """Runs that may be secrets with their test results. A run must mix
    letters with digits, or capitals inside with small letters, unless it is
    all digits: words of one alphabet have nothing to test."""
    found = F.filter(matches(text, RUN), lambda m: m["found"].rlike("[0-9]") | m["found"].rlike("[a-z][A-Z]"))
    made = F.transform(found, lambda m: bind(_battery(m["found"]), lambda t: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), t["enc"].alias("enc"), t["band"].alias("band"),
        t["bin"].alias("bin"), t["random"].alias("random"))))
    empty = F.array().cast("array<struct<start:int,end:int,enc:string,band:int,bin:int,random:boolean>>")
    return F.when(text.rlike(RUN[:-6]), made).otherwise(empty)


def discovery_limits(docs: DataFrame, text: Column) -> DataFrame:
    """(stratum, least bin) by Benjamini-Hochberg over all documents' runs."""
    from pyspark.sql import Window

    runs = docs.select(F.explode(candidates(text)).alias("c")).select(
        F.concat_ws("/", "c.enc", "c.band").alias("stratum"), "c.bin")
    counts = runs.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("stratum")))
    passing = F.pow(F.lit(10.0), -F.col("bin") / 10) <= FDR * F.col("rank") / F.col("m")
    return ranked.filter(passing).groupBy("stratum").agg(F.min("bin").alias("least"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256,
    spans (``kind:start:end``, base and ``random`` ones); :func:`redact` gives
    the texts with the spans replaced."""
    scanned = _scanned(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(F.col("__id").alias(id_col), *[n(k) for k, _ in KINDS],
                          F.sha2(text(F.col("__base")), 256).alias("base_sha256"), text(F.col("__spans")).alias("spans"))


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    pairs = F.struct("stratum", "least")
    limits = discovery_limits(docs, text).agg(F.map_from_entries(F.collect_list(pairs))).scalar()  # a row per stratum: at most 4 x 31
    rank = len(KINDS)
    base = docs.withColumn("__limits", limits).withColumn("__base", base_spans(text)).withColumn("__cand", candidates(text))
    random = F.transform(F.filter("__cand", lambda c: c["random"] & F.coalesce(
        c["bin"] >= F.element_at(F.col("__limits"), F.concat_ws("/", c["enc"], c["band"])), F.lit(False))),
        lambda c: F.struct(c["start"].alias("start"), F.lit(rank).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end")))
    return base.withColumn("__spans", F.sort_array(F.concat("__base", random))).drop("__cand", "__limits")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same columns with every span of the text replaced by ``mask``
    (overlapping spans by one) and the number of spans in ``n_spans``."""
    scanned = _scanned(docs, text_col)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
                     ).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), gap.alias("out"))

    cut = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return (scanned.withColumn("n_spans", F.size("__spans"))
            .withColumn(text_col, F.when(F.size("__spans") > 0, cut).otherwise(text)).drop("__base", "__spans"))
