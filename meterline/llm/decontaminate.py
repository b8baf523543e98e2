"""Operator 1: benchmark decontamination. DataFrame functions only.

Method. Both sides are turned into templates: numbers (also spelled out),
units after a number and names (capitalised words inside a sentence) become
typed placeholders, other words lose case and punctuation. A second template
leaves names as words, so a copy in other case is met, too. White space of any
kind and length is one space. Every run of ``WINDOW`` words of either template
is hashed, and documents' windows are hash-joined
with the benchmark's. Windows of one document and item that lie on the same
diagonal (document position minus item position) are one alignment, if its
slots are consistent: within the aligned windows, each value of the item
stands for one value in the document. A question whose numbers or names were
changed throughout passes (a re-parameterised leak, ``exact`` is false); a
passage that merely has numbers in the same places does not. Diagonals that
lie no further apart than the item is long are one chain: words put in, left
out or changed split a copy over several. A chain leaks the item when

* the item's words that it covers are as many as a run of ``COVER`` percent of
  the item's windows has, or
* one alignment has a run of ``RUN`` windows, however long the item is.

Items shorter than a window are compared as one window of all their words.
Items of less than ``SHORTEST`` words, which any text may hold by chance, leak
only where they are all the words of a text or of one of its lines.

Scale. Documents are never shuffled: their windows are hashed inside the row
and met with the benchmark's window table, which is broadcast after its size
is checked and joined by shuffle beyond that. Only hits are shuffled, summed
first per (document, item, diagonal), so a passage that a third of all
documents repeat makes one small group per document.

Defined results: null or empty texts match nothing; several rows with the
same id and text give the same rows once; null ids are kept as ids; several
texts under one id or without id are compared each on its own; extra
columns are ignored; an empty table on either side gives an empty result; an
item without words leaks nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .scratch import written

WINDOW = 8
SHORTEST = 5  # words of an item that leaks inside a line
COVER = 50
RUN = 25  # windows: 32 words in a row
MAX_BROADCAST = 2_000_000  # windows of 16 bytes
NAME, NUMBER, UNIT = "ⓝ", "⓪", "ⓤ"  # signs that case folding keeps
# Spelled numbers and units of measure.
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
           "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million").split()
UNITS = ("mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs hours minutes seconds days weeks months years "
         "usd eur dollars euros cents percent kmh mph meters metres miles feet inches grams pounds liters litres").split()


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _raw_words(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits, with ``.`` and ``,``
    inside a number left out."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _template(text: Column, use) -> Column:
    """``use(plain, named, raw)`` on the template words without and with name
    placeholders and the raw words they stand for, position by position."""
    joined = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "(\\p{N})[.,](?=\\p{N})", "$1")
    # A name: capital and small letters after white space that follows a small letter, a digit, a comma or a semicolon.
    capital = "\\p{Lu}(?<=[\\p{Ll}\\p{N},;]%s\\p{Lu})\\p{Ll}"

    def placed(raw: Column) -> Column:
        number = lambda w: w.isin(NUMBERS) | w.rlike("\\p{N}$")
        mixed = lambda w: F.regexp_replace(F.regexp_replace(w, "\\p{N}+", NUMBER),
                                           f"(?<={NUMBER})(?:{'|'.join(UNITS)})(?!\\p{{L}})", UNIT)
        after = lambda i: F.coalesce(number(F.get(raw, i - 1)), F.lit(False))
        return F.transform(raw, lambda w, i: F.when(w.isin(NUMBERS), NUMBER).when(w.rlike("\\p{N}"), mixed(w))
                           .when(w.isin(UNITS), F.when(after(i), UNIT).otherwise(w)).otherwise(w))

    def named(whole: Column, plain: Column) -> Column:
        # White space and the signs themselves are one space.
        spaced = F.regexp_replace(whole, f"[\\s\\p{{Z}}{NAME}{UNIT}]+", " ")
        marked = F.lower(F.regexp_replace(spaced, capital % " " + "\\p{L}*", NAME))
        words = F.array_remove(F.split(marked, f"[^\\p{{L}}\\p{{N}}{NAME}]+"), "")
        return F.zip_with(plain, words, lambda w, n: F.when(n.startswith(NAME), NAME).otherwise(w))

    def split(whole: Column) -> Column:
        blank = f"[\\s\\p{{Z}}{NAME}{UNIT}]"
        some = whole.rlike(capital % blank) | whole.rlike(blank + "{2}\\p{Lu}\\p{Ll}")
        return bind(_raw_words(whole), lambda raw: bind(placed(raw), lambda p: use(p, F.when(some, named(whole, p)).otherwise(p), raw)))
    return bind(joined, split)


def _windows(plain: Column, named: Column, size: int) -> Column:
    """(at, h): hashes of all windows of ``size`` template words, and of those
    that hold names once more with their placeholders."""
    def hashes(words: Column, wanted) -> Column:
        return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
            wanted(F.sequence(F.lit(0), F.size(h) - size)), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(h, i + 1, size)).alias("h"))))

    none = F.array().cast("array<struct<at:int,h:bigint>>")
    with_names = lambda m: F.when(F.array_contains(m, NAME), hashes(m, lambda at: F.filter(
        at, lambda i: F.array_contains(F.slice(m, i + 1, size), NAME)))).otherwise(none)
    return F.when(F.size(plain) >= size, F.concat(hashes(plain, lambda at: at), bind(named, with_names))).otherwise(none)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(h, item, at, need, size): one row per window of each item (and variant,
    if it holds names); an item shorter than ``WINDOW`` has one window, of all
    its words, one shorter than ``SHORTEST`` none."""
    t = items.select(F.col("__item").alias("item"), _template(F.col("__text"), lambda p, m, _: F.struct(p.alias("p"), m.alias("m"))).alias("t"))
    t = t.filter(F.size("t.p") >= SHORTEST)
    sizes = F.least(F.size("t.p"), F.lit(WINDOW))
    hs = F.coalesce(*[F.when(sizes == n, _windows(F.col("t.p"), F.col("t.m"), n)) for n in range(SHORTEST, WINDOW + 1)])
    return t.select("item", sizes.alias("size"), (F.size("t.p") - sizes + 1).alias("need"), F.inline(hs))


def _row(id_col: str, text_col: str) -> Column:
    """Rows of one id and text are the same; null ids and texts count, too."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("__row")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and leaked item: id, item id, n_windows (matched,
    on the best chain), need (windows of the item) and exact (its alignments
    without a differing slot leak the item, too)."""
    leaks = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return leaks.groupBy(F.col("__id").alias(id_col), F.col("item").alias(item_col)).agg(
        F.max("n").alias("n_windows"), F.first("need").alias("need"), F.bool_or("exact").alias("exact"))


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(__id, __row, item, n, need, exact) of the chains that leak their item."""
    items = benchmark.select(F.col(item_col).alias("__item"), F.col(item_text_col).alias("__text")).dropDuplicates()
    listed = benchmark_windows(items)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), _row(id_col, text_col))
    sizes = [r[0] for r in listed.select("size").distinct().collect()]  # at most WINDOW rows

    # One scan for all sizes; the item that a hash belongs to knows its size.
    windows = lambda p, m: F.concat(*[_windows(p, m, n) for n in sizes])
    if sizes:
        hits = source.select("__id", "__row", F.inline(_template(F.col("__text"), lambda p, m, _: windows(p, m))).alias("pos", "h"))
        found = hits.join(bounded_broadcast(written(listed), MAX_BROADCAST), "h")
    else:
        found = source.select("__id", "__row", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")).limit(0).join(listed, "h")
    aligned = found.groupBy("__id", "__row", "item", "need", "size", (F.col("pos") - F.col("at")).alias("shift")).agg(
        F.collect_set("at").alias("ats"))
    # A chain has at most what all diagonals of the document and item have.
    whole = aligned.groupBy("__id", "__row", "item", "need", "size").agg(F.collect_list(F.struct("shift", "ats")).alias("all"))
    whole = whole.filter(_covers(F.flatten("all.ats")) | (_run(F.flatten("all.ats")) >= RUN))
    aligned = written(whole.select("__id", "__row", "item", "need", "size", F.inline("all")))  # the only scan of all documents
    order = Window.partitionBy("__id", "__row", "item").orderBy("shift")
    apart = F.col("shift") - F.lag("shift").over(order) >= F.col("need") + F.col("size")
    chained = _consistent(aligned, source, items).withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    chains = chained.withColumn("chain", F.sum("apart").over(order)).groupBy("__id", "__row", "item", "need", "size", "chain").agg(
        F.flatten(F.collect_list("ats")).alias("ats"), F.flatten(F.collect_list(F.when(F.col("exact"), F.col("ats")))).alias("exact_ats"),
        F.max(_run(F.col("ats"))).alias("run"), F.max(F.when(F.col("exact"), _run(F.col("ats")))).alias("exact_run"))
    leaks = chains.filter(_covers(F.col("ats")) | (F.col("run") >= RUN))
    exact = _covers(F.col("exact_ats")) | (F.coalesce("exact_run", F.lit(0)) >= RUN)
    leaks = leaks.select("__id", "__row", "item", F.size(F.array_distinct("ats")).alias("n"), "need", exact.alias("exact"))
    return leaks.unionByName(_whole_lines(source, items))


def _whole_lines(source: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks of items shorter than ``SHORTEST`` words: texts or lines of them
    that have just the item's words."""
    few = items.select(F.col("__item").alias("item"), _raw_words(F.col("__text").cast("string")).alias("w"))
    few = written(few.filter((F.size("w") > 0) & (F.size("w") < SHORTEST)).select("item", F.concat_ws(" ", "w").alias("line")).distinct())
    if few.isEmpty():
        return source.limit(0).select("__id", "__row", F.lit(None).cast(few.schema["item"].dataType).alias("item"), F.lit(1).alias("n"),
                                      F.lit(1).alias("need"), F.lit(True).alias("exact"))
    text = F.col("__text").cast("string")
    lines = F.transform(F.concat(F.split(text, "\n"), F.array(text)), lambda x: F.concat_ws(" ", _raw_words(x)))
    lines = source.select("__id", "__row", F.explode(F.array_distinct(lines)).alias("line")).filter("line <> ''")
    return lines.join(bounded_broadcast(few, MAX_BROADCAST), "line").select(
        "__id", "__row", "item", F.lit(1).alias("n"), F.lit(1).alias("need"), F.lit(True).alias("exact"))


def _words(ats: Column) -> Column:
    """Positions of the item's words in the windows at ``ats``."""
    return F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(a, a + F.col("size") - 1))))


def _covers(ats: Column) -> Column:
    """Whether windows cover as many words as ``COVER`` percent of the item's
    windows do in a run."""
    return 100 * (F.size(_words(ats)) - F.col("size") + 1) >= COVER * F.col("need")


def _run(ats: Column) -> Column:
    """The longest run of neighbouring windows."""
    start = F.struct(F.lit(-2).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(s, a):
        n = F.when(a == s["at"] + 1, s["n"] + 1).otherwise(1)
        return F.struct(a.alias("at"), n.alias("n"), F.greatest(s["best"], n).alias("best"))
    return F.aggregate(F.array_sort(F.array_distinct(ats)), start, step, lambda s: s["best"])


def _consistent(aligned: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Keeps alignments whose slots are consistent; adds ``exact``. Only
    items with slots need the document's words again."""
    words = items.select(F.col("__item").alias("item"), F.col("__text").alias("item_text"))
    with_words = words.select("item", _template(F.col("item_text"), lambda p, m, r: F.struct(m.alias("m"), r.alias("r"))).alias("t"))
    with_words = with_words.select("item", F.col("t.m").alias("t"), F.col("t.r").alias("r"))
    slotted = F.filter(F.transform("t", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                       lambda x: x["w"].isin(NAME, NUMBER, UNIT))
    with_words = with_words.withColumn("slots", F.transform(slotted, lambda x: F.struct(x["i"].alias("i"), F.get("r", x["i"]).alias("v"))))
    joined = aligned.join(bounded_broadcast(with_words.select("item", "slots")), "item")
    plain = joined.filter(F.size("slots") == 0).select(*aligned.columns, F.lit(True).alias("exact"))
    # Few alignments have slots: they are written, and so met by their rows' texts once.
    todo = written(joined.filter(F.size("slots") > 0))
    if todo.isEmpty():
        return plain
    texts = docs.join(bounded_broadcast(todo.select("__row").distinct(), MAX_BROADCAST), "__row", "left_semi")
    raw = texts.select("__row", _template(F.col("__text"), lambda p, m, r: r).alias("dr")).dropDuplicates(["__row"])
    pairs = F.transform(F.filter("slots", lambda s: F.array_contains(_words(F.col("ats")), s["i"])),
                        lambda s: F.struct(s["v"].alias("v"), F.get("dr", s["i"] + F.col("shift")).alias("d")))
    checked = todo.join(raw, "__row").withColumn("pairs", F.array_distinct(pairs))
    one_to_one = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["v"])))
    checked = checked.filter(one_to_one).select(*aligned.columns, F.forall("pairs", lambda p: p["v"] == p["d"]).alias("exact"))
    return plain.unionByName(checked)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that leak no item, all columns kept; of rows that share
    an id (or have none) only those go whose own text leaks."""
    rows = written(_leaks(docs, benchmark, id_col, text_col).select(F.col("__row").alias("__leak")).distinct())
    return docs.join(bounded_broadcast(rows, MAX_BROADCAST), _row(id_col, text_col) == F.col("__leak"), "left_anti")
