"""Operator 9: Merkle fixity audit of WARC replicas. DataFrame functions only.

Method. A WARC replica is a table of records with a file, an offset in it and
the record's bytes. Each record is hashed (SHA-256 over length and bytes). A
leaf's number comes from the record itself (its id within the file), so a lost
or added record moves no other one. Leaves are cut into ranges of ``FANOUT``
neighbouring numbers; a range's hash is that of its children's hashes in order,
and so on up to one root per file. The audit compares the roots of two
replicas and descends only into ranges whose hashes differ (or that one side
lacks), level by level, until it reaches leaves; their records are matched by
id and digest. What it reads below the roots grows with the damage, not with
the archive.

Files hold ``PER_FILE`` ids. Records without an id or of an id that repeats
are spread over ``SPREAD`` files of their own by their hash, and equal ones are
one row with a count, so no group holds all rows of a frequent id.

Defined results: null payloads are hashed as empty; each copy of a record
counts; records that one side lacks are reported as missing or extra, and as
changed if the other side has another record of that id in its place (for null
ids and repeated ones in the order of their digests); empty replicas have no
roots; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast

FANOUT = 16
PER_FILE = 1024
LEVELS = 3          # FANOUT ** LEVELS >= PER_FILE
SPREAD = 1 << 16
MAX_BROADCAST = 1_000_000  # repeated ids


def warc_record(uri: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text: header lines, body, two breaks."""
    body = F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(uri.cast("string"), F.lit("")),
                    F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def replica(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(file, place, offset, length, id, digest, copies): the records of a
    table of pages in WARC files of ``per_file`` ids, in id order; ``offset`` is
    that of the first of equal copies, the others follow it.

    The record's bytes are hashed where they are read; only digests and
    lengths are shuffled."""
    record = warc_record(F.col(url_col), F.col(body_col))
    rows = pages.select(F.col(id_col).alias("id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha"))
    twice = pages.groupBy(F.col(id_col).alias("twice")).count().filter("count > 1 and twice is not null").select("twice")
    rows = rows.join(bounded_broadcast(twice, MAX_BROADCAST), F.col("id") == F.col("twice"), "left")
    own, key = F.col("id").isNotNull() & F.col("twice").isNull(), F.xxhash64("id", "sha")
    rows = rows.select(
        F.when(own, F.floor(F.col("id") / per_file)).otherwise(-1 - F.pmod(key, F.lit(SPREAD))).cast("long").alias("file"),
        F.when(own, F.pmod(F.floor("id"), F.lit(per_file))).otherwise(F.pmod(F.shiftright(key, 16), F.lit(per_file))).cast("long").alias("place"),
        "id", "length", "sha")
    rows = rows.groupBy("file", "place", "id", "length", "sha").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("file").orderBy("place", "id", "sha", "length").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0).cast("long")))
    return rows.select("file", "place", "offset", "length", "id",
                       F.sha2(F.concat_ws(":", "length", "sha"), 256).alias("digest"), "copies")


def tree(leaves: DataFrame) -> DataFrame:
    """(file, level, node, digest): all ranges; level 0 are the leaves, each
    of the records with its number. A file with numbers from ``FANOUT **
    LEVELS`` on has several nodes on the top level."""
    records = F.sort_array(F.collect_list(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "digest", F.col("copies").cast("string"))))
    level = leaves.groupBy("file", F.col("place").cast("long").alias("node")).agg(F.sha2(F.concat_ws(",", records), 256).alias("digest"))
    level = level.select("file", F.lit(0).alias("level"), "node", "digest")
    out = level
    for i in range(1, LEVELS + 1):
        level = level.groupBy("file", F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("kids"))
        joined = F.concat_ws(",", F.transform("kids", lambda k: F.concat_ws(":", k["node"].cast("string"), k["digest"])))
        level = level.select("file", F.lit(i).alias("level"), F.col("up").alias("node"), F.sha2(joined, 256).alias("digest"))
        out = out.unionByName(level)
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per differing record: file, place, finding (``changed``,
    ``missing`` in the right replica or ``extra`` in it), id, offset and
    length of the left record (of the right one if extra)."""
    from .scratch import written

    a, b = written(tree(left)), written(tree(right))

    def level(t: DataFrame, n: int, name: str) -> DataFrame:
        return t.filter(F.col("level") == n).select("file", "node", F.col("digest").alias(name))

    at = (level(a, LEVELS, "da").join(level(b, LEVELS, "db"), ["file", "node"], "full").filter(~F.col("da").eqNullSafe(F.col("db")))
          .select("file", "node"))
    for n in range(LEVELS - 1, -1, -1):
        # Only the children of differing ranges are looked at.
        below = at.withColumnRenamed("node", "up")

        def kids(t: DataFrame, name: str, n: int = n, below: DataFrame = below) -> DataFrame:
            return (level(t, n, name).withColumn("up", F.floor(F.col("node") / FANOUT).cast("long"))
                    .join(below, ["file", "up"], "left_semi").drop("up"))
        at = kids(a, "da").join(kids(b, "db"), ["file", "node"], "full").filter(~F.col("da").eqNullSafe(F.col("db"))).select("file", "node")
    # Records of differing leaves that the other side does not have as often; a leaf may differ for another record.
    at = written(at)
    sides = [t.withColumnRenamed("place", "node").join(at, ["file", "node"], "left_semi").withColumn("left", F.lit(left_side))
             for t, left_side in ((left, True), (right, False))]
    per = lambda side: F.sum(F.when(F.col("left") == side, F.col("copies")).otherwise(0))
    first = lambda side: F.min(F.when(F.col("left") == side, F.struct("file", "node", "offset", "length")))
    odd = sides[0].unionByName(sides[1]).groupBy("id", "digest").agg(
        (per(True) - per(False)).alias("more"), first(True).alias("l"), first(False).alias("r")).filter("more <> 0")
    held = F.when(F.col("more") > 0, F.col("l")).otherwise(F.col("r"))
    copies = odd.select("id", "digest", (F.col("more") > 0).alias("left"), held.alias("x"), F.explode(F.sequence(F.lit(1), F.abs("more"))).alias("copy"))
    nth = F.row_number().over(Window.partitionBy("id", "left").orderBy("digest", "copy"))
    copies = copies.withColumn("nth", nth)
    pair = copies.groupBy("id", "nth").agg(F.min(F.when(F.col("left"), F.col("x"))).alias("l"), F.min(F.when(~F.col("left"), F.col("x"))).alias("r"))
    finding = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("changed")
    x = F.coalesce("l", "r")
    return pair.select(x["file"].alias("file"), x["node"].alias("place"), finding.alias("finding"), "id", x["offset"].alias("offset"),
                       x["length"].alias("length"))


def aged(pages: DataFrame, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """A worn copy of a table of pages, for audits: of every page whose hash
    ends in 0 of 211 one character is changed, of 1 the end is cut off with
    as many bytes of padding, those of 2 are lost, and those of 3 are there a
    second time with another end."""
    wear = F.pmod(F.xxhash64(id_col), F.lit(211))
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    half = F.greatest(F.floor(F.length(body) / 2), F.lit(1)).cast("int")
    worn = (F.when(wear == 0, F.concat(F.substring(body, F.lit(1), half - 1), F.lit("~"), F.substring(body, half + 1, F.length(body))))
            .when(wear == 1, F.concat(F.substring(body, F.lit(1), half), F.repeat(F.lit("0"), F.length(body) - half))).otherwise(F.col(body_col)))
    copies = F.when(wear == 2, F.array().cast("array<boolean>")).when(wear == 3, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    again = pages.withColumn(body_col, worn).withColumn("__again", F.explode(copies))
    return again.withColumn(body_col, F.when(F.col("__again"), F.concat(body, F.lit("~"))).otherwise(F.col(body_col))).drop("__again")
