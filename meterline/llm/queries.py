"""Queries of the training-data operators, with their production parameters,
and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
_REG: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        _REG[name] = fn
        if sql:
            _SQL[name] = sql
        return fn
    return register


def queries() -> dict[str, Query]:
    return dict(_REG)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def jaccard_components(size: int, percent: int, more: str = "") -> str:
    """DuckDB SQL: components of documents under exact links of whole
    shingle sets, by counting the shingles that two sets share."""
    shingle = " || ' ' || ".join(f"words[i + {j}]" if j else "words[i]" for j in range(size))
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size} THEN [array_to_string(words, ' ')]
                 ELSE list_sort(list_distinct(list_transform(range(1, len(words) - {size - 2}), lambda i: {shingle}))) END AS shingles
  FROM w),
c AS (SELECT shingles, min(doc_id) AS rep, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
e AS (SELECT rep, n, unnest(shingles) AS shingle FROM c),
p AS (
  SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS n_both
  FROM e x JOIN e y ON x.shingle = y.shingle AND x.rep <> y.rep AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
  GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * n_both >= {percent} * (na + nb - n_both)),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.root),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id{more}
FROM s LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN m ON m.node = c.rep"""


HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
              AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5"""


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: (verdict, rule), as the contract fixes them.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


#: Measure: (counted, per, highest rate, margin above the third quartile, highest fence), per mille.
QUALITY = {"symbols": ("n_symbols", "n_words", 10000, 100, 400), "capitals": ("n_capitals", "word_chars", 10000, 150, 500),
           "dup_lines": ("n_dup_lines", "n_lines", 10000, 300, 600), "repeats": ("n_repeat_words", "n_words", 10000, 250, 300),
           "word_len": ("word_chars", "n_words", 100000, 3000, 14000)}


def quality_sql() -> str:
    """DuckDB SQL: whole-text counts, quartile fences by group, verdicts."""
    bins = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS measure, least({top}, (1000 * {a}) // greatest({b}, 1)) AS bin FROM m"
                              for k, (a, b, top, _, _) in QUALITY.items())
    margin = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v[3]}" for k, v in QUALITY.items()) + " END"
    cap = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v[4]}" for k, v in QUALITY.items()) + " END"

    def fence(name: str, keys: str) -> str:
        return f"""{name} AS (
  SELECT {keys}measure, any_value(total) AS total, any_value(low) AS low, any_value(high) AS high FROM (
    SELECT *, q1 - greatest(3 * (q3 - q1), {margin}) AS low, least(q3 + greatest(3 * (q3 - q1), {margin}), {cap}) AS high FROM (
      SELECT {keys}measure, any_value(total) AS total, min(bin) FILTER (WHERE rn >= ceil(0.25 * total)) AS q1,
             min(bin) FILTER (WHERE rn >= ceil(0.75 * total)) AS q3
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys}measure ORDER BY bin) AS rn,
                   count(*) OVER (PARTITION BY {keys}measure) AS total FROM bins) GROUP BY ALL)) GROUP BY ALL)"""
    order = "CASE measure " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(QUALITY)) + " END"
    return f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS t
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
bins AS ({bins}),
{fence("own", "lang, source, ")}, {fence("of_lang", "lang, ")}, {fence("of_all", "")},
judged AS (
  SELECT b.doc_id, measure, bin > CASE WHEN o.total >= 30 THEN o.high WHEN l.total >= 30 THEN l.high ELSE a.high END
         OR measure = 'word_len' AND bin < CASE WHEN o.total >= 30 THEN o.low WHEN l.total >= 30 THEN l.low ELSE a.low END AS beyond
  FROM bins b JOIN own o USING (measure) JOIN of_lang l USING (measure) JOIN of_all a USING (measure)
  WHERE b.lang IS NOT DISTINCT FROM o.lang AND b.source IS NOT DISTINCT FROM o.source AND b.lang IS NOT DISTINCT FROM l.lang),
failing AS (SELECT doc_id, string_agg(measure, ',' ORDER BY {order}) AS failed FROM judged WHERE beyond GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM m LEFT JOIN failing USING (doc_id)"""


@query("op6_quality_rules", quality_sql())
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_jaccard_join", jaccard_components(5, 80))
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_warc_fixity")
def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a WARC replica of ``pages`` against a worn copy of it."""
    from .scratch import written
    from .warc_fixity import aged, audit, replica

    pages = table(spark, sf_dir, "pages")
    return audit(written(replica(pages)), written(replica(aged(pages))))


@query("op10_html_wrappers")
def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_wrappers import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op12_minhash_near_dedup", jaccard_components(3, 85, ", coalesce(m.root, s.doc_id) = s.doc_id AS kept"))
def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .circulant_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten_embeddings

    return whiten_embeddings(table(spark, sf_dir, "embeddings"))


@query("op13_hard_negatives", HARD_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on by one, as the contract has it."""
    from .hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label=moved)
