from __future__ import annotations

import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from meterline.operators.labels import LABELS  # noqa: E402
from meterline.session import build_session  # noqa: E402

SAMPLE_SCHEMA = ("name string, env string, " + ", ".join(f"{c} string" for c in LABELS) +
                 ", le string, t bigint, value double")


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", partitions=8)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="meterline-test-ckpt-"))
    yield s


def expand(notation: str) -> list[float | None]:
    """Series notation: ``0+32x60`` (start, step, count), ``_`` = missing,
    plain numbers as listed."""
    out: list[float | None] = []
    for tok in notation.split():
        if tok == "_":
            out.append(None)
        elif "x" in tok:
            head, n = tok.split("x")
            sign = "+" if "+" in head[1:] else "-"
            start, step = head.rsplit(sign, 1) if sign in head[1:] else (head, "0")
            start, step = float(start), float(step) * (1 if sign == "+" else -1)
            out.extend(start + i * step for i in range(int(n) + 1))
        else:
            out.append(float(tok))
    return out


def samples(spark, series: list[tuple[str, dict, str]], interval: int):
    """Sample table from (name, labels, notation) at ``interval`` seconds."""
    rows = []
    for name, labels, notation in series:
        for i, v in enumerate(expand(notation)):
            if v is None:
                continue
            lab = {"env": "", **{c: "" for c in LABELS}, "le": "", **labels}
            rows.append((name, lab["env"], *[lab[c] for c in LABELS], lab["le"], i * interval, v))
    return spark.createDataFrame(rows, SAMPLE_SCHEMA)
