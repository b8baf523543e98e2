"""Operator 5: toxicity by weak supervision.

Method. Many voters look at a text: lexicon words (a parameter, plus words
and word beginnings mined from labelled rows) and patterns (shouting, rows of
exclamation marks, insults at "you"). A generative model with a hidden true
label estimates by expectation-maximisation how often each voter fires on
toxic and on clean texts; the given label is one more voter with an accuracy
of its own, so wrong labels are outvoted. Voters that fire together more than
the label explains are correlated: each one's vote is divided by one plus its
correlations with the others. A linear (logistic) classifier is then trained
on the model's posterior labels and scores every whole text.

Training uses at most ``SAMPLE`` labelled rows, one for each of the ids of
smallest hash (of several texts under an id that of smallest hash), and never rows whose crc32(id as text) mod 3 is 1. Mined voters are at most
``MAX_CANDIDATES``, then ``MAX_VOTERS`` after a greedy cover of the toxic
rows, so copies of one text do not make voters of all its words. What reaches
the driver is bounded by these parameters. Scoring is one pass without a
shuffle.

Defined results: null and empty texts fire no voter and get the score of
such texts; repeated rows each give a row; null ids are not held out; labels
that are null are ignored, of several labels for an id the largest counts;
without labels of both classes every score is 0.5; extra columns
are ignored; language, source, label and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 12_000
MAX_CANDIDATES = 20_000
MAX_VOTERS = 300
LEAST_DOCS = 4          # toxic rows that a mined voter must fire on
PRECISION = 0.9
COVER = 4               # voters wanted per toxic row
PREFIXES = (3, 4, 5, 6, 7)
THRESHOLD = 0.7
KEPT_FEATURES, KEPT_WORDS = 30_000, 200_000  # words whose features or voters a worker keeps, some 20 and 30 MB
# Plain words (parameter); unknown ones do no harm, their weight is learned.
LEXICON = ("bastard clown disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic pig scum stupid trash "
           "ugly vermin worthless abruti arschloch basura cabron connard cretin dummkopf idiota idiote imbecil salaud "
           "schwein tonto trottel").split()
WORD = r"[^\W\d_]+"


def _patterns():
    return [re.compile(r"!{3,}"), re.compile(r"(?i)\byou(?:'re| are)? (?:a |an |such )?\w+"),
            re.compile(r"\b(?:[A-Z]{4,}\W+){4}"), re.compile(r"(?i)\b(?:kill|hate|shut up)\b")]


def features(word: str) -> list[str]:
    """The features a word can fire: the word itself and its beginnings."""
    return ["w:" + word, *["p:" + word[:n] for n in PREFIXES if len(word) > n]]


class _Features(dict):
    """word -> its features."""

    def __missing__(self, word):
        if len(self) >= KEPT_FEATURES:
            self.clear()
        self[word] = f = features(word)
        return f


class _Fired(dict):
    """word -> numbers of the voters it fires."""

    def __init__(self, voters):
        self.voters = voters

    def __missing__(self, word):
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = f = tuple(self.voters[x] for x in features(word) if x in self.voters)
        return f


def fired(text: str | None, of: dict, patterns) -> list[int]:
    """Voters that fire on a text; patterns are numbered from 0."""
    text = text or ""
    words = set(re.findall(WORD, text.lower()))
    return sorted({i for w in words for i in of[w]} | {i for i, p in enumerate(patterns) if p.search(text)})


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, y, text): the sample, joined by a broadcast of its ids, one row
    for each."""
    y = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
         .filter(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) != 1)
         .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(y), "id")
    # Of the rows of an id the text of smallest hash: as many rows as ids, however often one repeats.
    return rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _count_features(batches):
    import pyarrow as pa

    of = _Features()
    for batch in batches:
        n1, n0 = Counter(), Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(re.findall(WORD, (text or "").lower()))
            (n1 if y else n0).update({f for w in words for f in of[w]})
        keys = list(n1.keys() | n0.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n1[k] for k in keys], pa.int64()),
                                          pa.array([n0[k] for k in keys], pa.int64())], ["feature", "n1", "n0"])


def _fire_rows(batches, voters):
    import pyarrow as pa

    of, patterns = _Fired(voters), _patterns()
    for batch in batches:
        f = [fired(t, of, patterns) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(f, pa.list_(pa.int32()))], ["y", "fired"])


def choose_voters(rows: DataFrame) -> dict[str, int]:
    """feature -> voter number, after the patterns' numbers: the lexicon and
    a greedy cover of the toxic rows by precise features."""
    n = len(_patterns())
    voters = {f"w:{w}": n + i for i, w in enumerate(LEXICON)}
    counts = rows.select("text", "y").mapInArrow(_count_features, "feature string, n1 long, n0 long").groupBy("feature").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    good = counts.filter((F.col("n1") >= LEAST_DOCS) & (F.col("n1") >= PRECISION * (F.col("n1") + F.col("n0"))))
    found = [r["feature"] for r in good.orderBy(F.desc("n1"), "n0", "feature").limit(MAX_CANDIDATES).collect()]
    numbered = {f: i for i, f in enumerate(found)}
    toxic = [set(r["fired"]) for r in rows.filter("y = 1").select("text", "y").mapInArrow(
        lambda it: _fire_rows(it, {f: i + n for f, i in numbered.items()}), "y int, fired array<int>").collect()]
    need = [COVER] * len(toxic)
    holds: dict[int, list[int]] = {}
    for d, fs in enumerate(toxic):
        for f in fs:
            if f >= n:
                holds.setdefault(f - n, []).append(d)
    gain = {f: len(ds) for f, ds in holds.items()}
    while gain and len(voters) < MAX_VOTERS + len(LEXICON):
        best = min(gain, key=lambda f: (-gain[f], f))
        if gain[best] < LEAST_DOCS:
            break
        voters.setdefault(found[best], n + len(voters))
        for d in holds[best]:
            need[d] -= 1
            if need[d] == 0:
                for f in toxic[d]:
                    if f - n in gain:
                        gain[f - n] -= 1
        del gain[best]
    return voters


def label_model(x, y, rounds: int = 30):
    """Posterior of the hidden label, from voters ``x`` (0/1) and the given
    label; accuracies by EM, votes discounted by their correlations."""
    import numpy as np

    q = y.astype(float)
    votes = np.column_stack([x, y])
    for _ in range(rounds):
        w = np.stack([1 - q, q])                                    # class weights
        rate = (w @ votes + 0.5) / (w.sum(1, keepdims=True) + 1.0)  # P(fires | class)
        rest = votes - q[:, None] * rate[1] - (1 - q)[:, None] * rate[0]
        cov = rest.T @ rest
        sd = np.sqrt(np.diag(cov)) + 1e-9
        rho = np.clip(cov / sd[:, None] / sd, 0, 1)
        np.fill_diagonal(rho, 0)
        rho[rho < 0.1] = 0                                          # sampling noise
        weight = 1 / (1 + rho.sum(1))
        weight[-1] = 1.0                                            # the label is a source of its own
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        prior = np.log((q.sum() + 0.5) / ((1 - q).sum() + 0.5))
        z = prior + votes @ ((on - off) * weight) + off @ weight
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q


def linear_classifier(x, q, ridge: float = 0.1, rounds: int = 25):
    """Logistic regression on soft labels by Newton steps; bias last."""
    import numpy as np

    a = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = np.zeros(a.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(h, a.T @ (q - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(voters, weights) of the scorer; see the module text for its bounds."""
    import numpy as np

    from .scratch import small_batches, written

    small_batches(docs)
    rows = written(training_rows(docs, labels, id_col, text_col, label_col))
    voters = choose_voters(rows)
    n = len(_patterns()) + len(voters)
    got = rows.select("text", "y").mapInArrow(lambda it: _fire_rows(it, voters), "y int, fired array<int>").collect()
    if len({r["y"] for r in got}) < 2:  # nothing to tell apart
        return voters, np.zeros(n + 1)
    x, y = np.zeros((len(got), n)), np.array([r["y"] for r in got])
    for i, r in enumerate(got):
        x[i, r["fired"]] = 1
    return voters, linear_classifier(x, label_model(x, y))


def _score(batches, voters, weights):
    import numpy as np
    import pyarrow as pa

    of, patterns = _Fired(voters), _patterns()
    for batch in batches:
        z = np.array([weights[-1] + weights[fired(t, of, patterns)].sum() for t in batch.column(batch.num_columns - 1).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-z)), pa.float64())],
                                         [*batch.schema.names[:-1], "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score in [0, 1], predicted."""
    from pyspark.sql import types as T

    voters, weights = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(lambda it: _score(it, voters, weights), schema)
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns kept."""
    from pyspark.sql import types as T

    voters, weights = train(docs, labels, id_col, text_col)
    # The text goes last, a second time, and comes back as the score.
    rows = docs.withColumn("__text", F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    renamed = T.StructType([*schema.fields[:-1], T.StructField("__score", T.DoubleType())])
    scored = rows.mapInArrow(lambda it: (b.rename_columns([*b.schema.names[:-1], "__score"]) for b in _score(it, voters, weights)), renamed)
    return scored.filter(F.col("__score") < threshold).drop("__score")
