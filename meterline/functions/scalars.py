"""Column-level helpers (F1-F15): PromQL scalar semantics on Spark columns.

Everything here returns a ``Column`` built from built-in functions, so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F



def _nan() -> Column:
    return F.lit(float("nan"))


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp_min(c, floor) -> Column:
    """F1 ``clamp_min``: NaN stays NaN (Spark orders NaN above every number)."""
    c = col_(c)
    return F.when(F.isnan(c), c).otherwise(F.greatest(c, F.lit(floor)))


def prom_round(c) -> Column:
    """F2 ``round``: ties go up (PromQL), unlike Spark's HALF_UP on negatives."""
    return F.floor(col_(c) + F.lit(0.5)).cast("double")


def anchored(c, regex: str) -> Column:
    """F10 fully anchored regex match, as PromQL and the collector use it."""
    return col_(c).rlike(f"^(?:{regex})$")


def prom_div(a, b) -> Column:
    """J8 float division: x/0 is +-Inf, 0/0 and NaN operands are NaN.

    Plain ``/`` raises under ANSI mode and ``try_divide`` yields NULL, so the
    IEEE cases are spelled out.
    """
    a = col_(a).cast("double")
    b = col_(b).cast("double")
    return (F.when(F.isnan(a) | F.isnan(b), _nan())
            .when(b != 0, a / b)
            .when(a > 0, F.lit(float("inf")))
            .when(a < 0, F.lit(float("-inf")))
            .otherwise(_nan()))


def escape_label(c) -> Column:
    """F6 exposition label escaping: backslash, quote, newline (in that order)."""
    c = col_(c)
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit('"'), F.lit('\\"'))
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def unescape_label(c) -> Column:
    """Inverse of :func:`escape_label` for label values read from text."""
    # Cut at escaped backslashes, left to right, so that the one before an
    # "n" or a quote in a part is a real escape.
    plain = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.array_join(F.transform(F.split(col_(c), r"\\\\"), plain), "\\")


def nul_join(*cols) -> Column:
    """NUL-separated join with NULL rendered as ''."""
    return F.concat_ws("\u0000", *[F.coalesce(col_(c).cast("string"), F.lit("")) for c in cols])


def sha256_prefix(*cols, n: int = 24) -> Column:
    """first ``n`` hex digits of SHA-256 over the NUL-joined columns."""
    return F.substring(F.sha2(nul_join(*cols), 256), 1, n)


def _hmac_pads(secret: bytes) -> tuple[str, str]:
    block = 64
    if len(secret) > block:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(block, b"\x00")
    ipad = bytes(b ^ 0x36 for b in secret)
    opad = bytes(b ^ 0x5C for b in secret)
    return ipad.hex(), opad.hex()


def hmac_sha256_hex(secret: bytes, msg, spark) -> Column:
    """F7/D4 HMAC-SHA256 as a native expression (RFC 2104 over ``sha2``). The
    padded key is a one-row table read by scalar subqueries, so no plan text
    holds it and no row passes Python."""
    ipad, opad = map(bytes.fromhex, _hmac_pads(secret))
    key = spark.createDataFrame([(bytearray(ipad), bytearray(opad))], "inner_pad binary, outer_pad binary")
    inner = F.unhex(F.sha2(F.concat(key.select("inner_pad").scalar(), col_(msg).cast("binary")), 256))
    return F.sha2(F.concat(key.select("outer_pad").scalar(), inner), 256)


def utc_parse(c) -> Column:
    """ISO timestamp string -> UTC instant; invalid -> NULL.

    Relies on the session time zone being UTC for naive inputs.
    """
    return F.try_to_timestamp(col_(c))


def epoch_seconds(ts) -> Column:
    """Whole unix seconds of a TIMESTAMP or TIMESTAMP_NTZ (UTC) column."""
    return F.floor(F.unix_micros(col_(ts).cast("timestamp")) / F.lit(1_000_000)).cast("bigint")
