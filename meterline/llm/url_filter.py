"""Operator 4: URL verdicts from host/path rules and a naive Bayes model.

Method. A url gets the verdict of the longest rule that fits it. All others
are scored: host names are cut at dots, hyphens and digits, each letter run
is split into words by a unigram Viterbi search ("cheappills" -> cheap,
pills), and a multinomial naive Bayes model adds up the evidence of the host
words and the path words.

Training is weak: a (host, path words) group counts for the block class when
one of its words is a seed word, else for the allow class; the word counts of
all urls make the model. Word lists are parameters.

Scale. Pages are first counted per (host, path words); everything that is
learned or searched works on those distinct groups, on distinct letter runs
and on distinct words, never on single pages, so a host with a third of all
pages costs one group. The two scores come back by joins on host and on the
path's word list, which Spark splits when they are skewed. The unigram table
and the model are tables joined by key, never collected.

Defined results: a null url or one without ``://`` has empty host and path,
fits no rule and is scored as having no words (the class prior alone);
repeated rows each give a row; an empty table gives an empty result; columns
beyond id and url are ignored; of equally long rules that fit, the first by
text wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .scratch import written

# Seed words of unwanted sites (parameter; plain words).
BLOCK_SEEDS = ("ads", "adult", "bet", "bets", "betting", "casino", "gambling", "jackpot", "lottery", "malware",
               "payday", "phishing", "pills", "poker", "porn", "slots", "spam", "track", "tracker", "viagra", "xxx")
# Everyday words that host names are often made of (parameter).
COMMON_WORDS = ("best", "blog", "book", "cheap", "city", "data", "farm", "food", "free", "game", "home", "info", "life",
                "mail", "media", "news", "online", "photo", "play", "shop", "sport", "store", "tech", "travel", "win",
                "world")
MIN_WORD = 3            # shorter dictionary words would cut up invented names
MAX_WORD = 24
UNKNOWN = (-9.0, -1.5)  # log probability of an unknown word: start, per letter
WORDS = "[^\\p{L}]+"


def parse_url(url) -> tuple:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _words(text):
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` to (.., host, path): a hash join of
    the host's suffixes with the rules' hosts, then the longest path prefix."""
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    # The rules of a host are gathered first, so that each url meets one list per suffix.
    by_host = rules.groupBy("rule_host").agg(F.collect_list(F.struct(
        F.length("rule").alias("n"), F.col("rule"), F.col("rule_path"), F.col("verdict"))).alias("found"))
    keys = (urls.select("host", "path").distinct()
            .select("host", "path", F.explode(suffixes).alias("rule_host"))
            .join(bounded_broadcast(by_host), "rule_host")
            .select("host", "path", F.inline("found"))
            .filter(F.col("path").startswith(F.col("rule_path")))
            .groupBy("host", "path")
            .agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.col("n"), F.col("rule"))).alias("best")))
    return (urls.join(keys, ["host", "path"], "left")
            .withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.verdict")).drop("best"))


def viterbi(run: str, found: list[tuple[int, int, float]]) -> list[str]:
    """Best split of ``run``: ``found`` holds (start, length, log p) of its
    substrings that are words; any other substring may be one unknown word.
    Ties go to the shorter last word."""
    n, best, back = len(run), [0.0], [0]
    at: dict[int, list[tuple[int, float]]] = {}
    for start, length, p in found:
        at.setdefault(start + length, []).append((start, p))
    # The start that is best for an unknown word, whatever its end: linear in the run.
    reach = (0.0, 0)
    for end in range(1, n + 1):
        options = [(best[start] + p, start) for start, p in at.get(end, ())]
        score, start = max([*options, (reach[0] + UNKNOWN[0] + UNKNOWN[1] * end, reach[1])])
        best.append(score)
        back.append(start)
        reach = max(reach, (score - UNKNOWN[1] * end, end))
    out, end = [], n
    while end:
        out.append(run[back[end]:end])
        end = back[end]
    return out[::-1]


def _segment(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        words = [viterbi(run, [(f["start"], f["n"], f["p"]) for f in found] if found is not None else [])
                 for run, found in zip(pdf["run"], pdf["found"])]
        yield pd.DataFrame({"run": pdf["run"].astype(object), "words": words})


def unigrams(groups: DataFrame, seeds: tuple[str, ...]) -> DataFrame:
    """(word, p): log probabilities from path words, from the parts of
    hyphenated host labels and, once each, from the given word lists."""
    spark = groups.sparkSession
    listed = spark.createDataFrame([(w, 1) for w in {*seeds, *COMMON_WORDS}], "word string, n long")
    labels = F.filter(F.split("host", "\\."), lambda x: x.contains("-"))
    from_hosts = groups.groupBy("host").agg(F.sum("n").alias("n")).select(
        F.explode(F.flatten(F.transform(labels, _words))).alias("word"), "n")
    from_paths = groups.groupBy("path_words").agg(F.sum("n").alias("n")).select(F.explode("path_words").alias("word"), "n")
    counts = (listed.unionByName(from_hosts).unionByName(from_paths)
              .filter(F.length("word").between(MIN_WORD, MAX_WORD)).groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("word", F.log(F.col("n") / total).alias("p"))


def segment_hosts(groups: DataFrame, words: DataFrame) -> DataFrame:
    """(host, host_words): every letter run of every distinct host, split."""
    hosts = groups.select("host").distinct()
    runs = hosts.select(F.explode(_words(F.col("host"))).alias("run")).distinct()
    cuts = runs.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("start")).select(
        "run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("run") - F.col("start")))).alias("n"))
    cuts = cuts.filter(F.col("n") >= MIN_WORD).withColumn("word", F.expr("substring(run, start + 1, n)"))
    found = cuts.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("start", "n", "p")).alias("found"))
    split = (runs.join(found, "run", "left").select("run", "found")
             .mapInPandas(_segment, "run string, words array<string>"))
    return (hosts.select("host", F.posexplode_outer(_words(F.col("host"))).alias("i", "run")).join(split, "run", "left")
            .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("i", "words"))).alias("parts"))
            .select("host", F.flatten(F.transform("parts", lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))).alias("host_words")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], seeds: tuple[str, ...] = BLOCK_SEEDS,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict (``block`` or
    ``allow``), log_odds (of block, for urls without a rule too).

    ``rules`` are (verdict, rule) with rules like ``example.net/en/``.
    """
    spark = pages.sparkSession
    url = F.col("__url")
    host, path = parse_url(url)
    # Derived names cannot clash: only the id and the url are read.
    urls = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).select(
        "__id", host.alias("host"), path.alias("path")).withColumn("path_words", _words(F.col("path")))
    listed = spark.createDataFrame(
        [(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for v, r in rules],
        "rule string, rule_host string, rule_path string, verdict string")

    # Pages are counted once; what is learned from the counts is written, too, as several steps read it.
    groups = written(urls.groupBy("host", "path_words").agg(F.count("*").alias("n")))
    segmented = written(segment_hosts(groups, written(unigrams(groups, seeds))))
    bag = groups.join(segmented, "host", "left").select(
        F.concat(F.coalesce("host_words", F.array().cast("array<string>")), "path_words").alias("words"), "n")
    bag = bag.withColumn("y", F.arrays_overlap("words", F.array(*map(F.lit, seeds))).cast("int"))
    per_word = bag.select(F.explode("words").alias("word"), "y", "n").groupBy("word").agg(
        F.sum(F.col("n") * F.col("y")).alias("bad"), F.sum(F.col("n") * (1 - F.col("y"))).alias("good"))
    per_word = written(per_word)
    sums = per_word.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("v"))
    classes = bag.agg(F.sum(F.col("n") * F.col("y")).alias("bad"), F.sum(F.col("n") * (1 - F.col("y"))).alias("good"))
    one = lambda df, e: df.select(e).scalar()
    bad_all = one(sums, F.coalesce(F.col("bad"), F.lit(0)) + F.col("v"))
    good_all = one(sums, F.coalesce(F.col("good"), F.lit(0)) + F.col("v"))
    prior = one(classes, F.log((F.coalesce("bad", F.lit(0)) + 1) / (F.coalesce("good", F.lit(0)) + 1)))
    model = per_word.select("word", (F.log((F.col("bad") + 1) / bad_all) - F.log((F.col("good") + 1) / good_all)).alias("w"))

    def scored(keys: DataFrame, key: str, words: str, name: str) -> DataFrame:
        return (keys.select(key, F.explode(words).alias("word")).join(model, "word")
                .groupBy(key).agg(F.sum("w").alias(name)))

    by_host = scored(segmented, "host", "host_words", "host_score")
    by_path = scored(groups.select("path_words").distinct().withColumn("words", F.col("path_words")),
                     "path_words", "words", "path_score")
    judged = (match_rules(urls, listed).join(by_host, "host", "left").join(by_path, "path_words", "left")
              .withColumn("log_odds", F.round(prior + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)), 9)))
    return judged.select(
        F.col("__id").alias(id_col), "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
