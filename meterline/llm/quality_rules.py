"""Operator 6: quality rules with adaptive thresholds. DataFrame functions only.

Method. Every document gets whole-text measures (repeated words, repeated
lines, symbols, capitals, word length). For each measure a histogram sketch
is kept per (language, source): integer per-mille bins with counts. Sketches
of this kind merge exactly by adding counts, so partial sketches of any split
of the data give the same quantiles, and the sketch of a language is the sum
of its sources' sketches. A document fails when a measure lies beyond the
fence ``Q3 + max(K * (Q3 - Q1), margin)`` (word length also below ``Q1`` minus
the same) of its own group. Groups of fewer than ``MIN_GROUP`` documents take
the sketch of their language, and that of the whole table below that. The
thresholds are joined back to the documents and filter them.

Scale. Per document everything is computed inside its row; only the small
measures are shuffled, pre-aggregated into bins (at most ``TOP + 1`` per
group and measure), so a source with a third of all rows is one histogram.
The threshold table has one row per (language, source) and is joined by key.

A robust fence moves with its group but not with single documents: clean
documents stay however the group is composed, as long as junk is not the
majority of the group; ``CAP`` bounds each fence so that a group of junk does
not excuse itself.

Defined results: null text has no words and fails (n_words < 20); repeated
rows each give a row; null language or source form groups of their own; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
TOP = 10_000            # measures saturate here: 10 times the word count
MIN_GROUP = 30
K = 3
# Per-mille of: (margin above Q3, highest fence). Documented parameters.
FENCES = {
    "symbols": (100, 400),     # symbols per word
    "capitals": (150, 500),    # capital letters per word character
    "dup_lines": (300, 600),   # repeated lines per line
    "repeats": (250, 300),     # words in repeated windows per word
    "word_len": (3000, 14000),  # characters per word
}


def _size(a: Column) -> Column:
    return F.size(a).cast("long")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more (first included).

    Windows are compared by 64-bit hashes inside one document. The positions
    of repeated windows come from sorting (hash, position) and looking at the
    neighbours; each such position then covers the words up to the next one,
    at most ``window``.
    """
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    windows = lambda h: F.when(F.size(h) >= window, F.transform(
        F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))).otherwise(
            F.array().cast("array<bigint>"))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.when(
            i + 1 < F.size(p), F.least(F.lit(window), F.get(p, i + 1) - x)).otherwise(window)),
            F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda z: F.sort_array(F.transform(F.filter(
            F.transform(z, lambda x, k: F.struct(x["i"].alias("i"), (
                (x["h"] == F.get(z, k - 1)["h"]) | (x["h"] == F.get(z, k + 1)["h"])).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"]))
        return bind(ordered, lambda z: bind(twice(z), cover))

    return bind(hashes(words), lambda hw: bind(windows(hw), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeats(h))))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``m``: the struct of all counts of the document's whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    count = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    counted = bind(words_of(text), lambda w: bind(lines, lambda x: F.struct(
        _size(w).alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count("[^#*$%&|<>]+").alias("n_symbols"),
        (_size(x) - _size(F.array_distinct(x))).alias("n_dup_lines"),
        _size(x).alias("n_lines"),
        count("[^A-Z]+").alias("n_capitals"),
        repeated_words(w).alias("n_repeat_words"))))
    return docs.withColumn("m", counted)


def rates(m: Column) -> dict[str, Column]:
    """Per-mille rates as integers, saturating at ``TOP``."""
    rate = lambda a, b, top=TOP: F.least(F.lit(top), F.floor(1000 * m[a] / F.greatest(m[b], F.lit(1)))).cast("int")
    return {"symbols": rate("n_symbols", "n_words"), "capitals": rate("n_capitals", "word_chars"),
            "dup_lines": rate("n_dup_lines", "n_lines"), "repeats": rate("n_repeat_words", "n_words"),
            "word_len": rate("word_chars", "n_words", 10 * TOP)}


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bin, n): mergeable histograms of all documents."""
    binned = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("bin")) for k in FENCES])
    return (measured.select(*keys, F.explode(binned).alias("b"))
            .groupBy(*keys, "b.measure", "b.bin").agg(F.count("*").alias("n")))


def quantiles(sk: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """Quantiles (lower: the first bin that reaches the rank) and the number
    of documents of each (keys, measure)."""
    from pyspark.sql import Window

    by = [*keys, "measure"]
    run = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sk.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(F.max("total").alias("total"), *[
        F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), F.col("bin"))).alias(name) for name, q in at.items()])


def fences(sk: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its size and a struct {measure: (low, high)}."""
    q = quantiles(sk, keys, {"q1": 0.25, "q3": 0.75})
    spread = lambda k: F.greatest(K * (F.col("q3") - F.col("q1")), F.lit(FENCES[k][0]))
    one = lambda k: F.max(F.when(F.col("measure") == k, F.struct(
        (F.col("q1") - spread(k)).alias("low"),
        F.least(F.col("q3") + spread(k), F.lit(FENCES[k][1])).alias("high")))).alias(k)
    return q.groupBy(*keys).agg(F.max("total").alias("total"), F.struct(*[one(k) for k in FENCES]).alias("fence")) if keys else \
        q.agg(F.max("total").alias("total"), F.struct(*[one(k) for k in FENCES]).alias("fence"))


def judge_quality(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and failed (the measures beyond their
    fence)."""
    picked = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"),
                         F.col(text_col).alias("__text"))
    measured = measures(picked, "__text").drop("__text")
    r = rates(F.col("m"))
    # Texts are measured once; all that follows reads the small numbers.
    measured = written(measured.select("__id", "__lang", "__source", "m", *[v.alias(k) for k, v in r.items()]))

    # Sketches merge: the sources' bins add up to the language's, and those to the table's.
    by_source = sketch(measured, ["__lang", "__source"])
    by_lang = by_source.groupBy("__lang", "measure", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    own = fences(by_source, ["__lang", "__source"]).alias("o")
    lang = fences(by_lang, ["__lang"]).alias("l")
    whole = fences(overall, []).select("fence").scalar()
    chosen = (own.join(lang, F.col("o.__lang").eqNullSafe(F.col("l.__lang")), "left")
              .select(F.col("o.__lang").alias("k_lang"), F.col("o.__source").alias("k_source"),
                      F.when(F.col("o.total") >= MIN_GROUP, F.col("o.fence"))
                      .when(F.col("l.total") >= MIN_GROUP, F.col("l.fence")).otherwise(whole).alias("fence")))
    joined = measured.join(chosen, F.col("__lang").eqNullSafe(F.col("k_lang")) & F.col("__source").eqNullSafe(F.col("k_source")), "left")
    beyond = [F.when((F.col(k) > F.col(f"fence.{k}.high")) | ((F.col(k) < F.col(f"fence.{k}.low")) & F.lit(k == "word_len")), F.lit(k))
              for k in FENCES]
    m = lambda k: F.col(f"m.{k}")
    base_failed = (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > REPEAT_PERCENT * m("n_words"))
    out = joined.withColumn("failed", F.filter(F.array(*beyond), lambda x: x.isNotNull())).withColumn("base_failed", base_failed)
    return out.select(
        F.col("__id").alias(id_col), *[m(k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed"))
