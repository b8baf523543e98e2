"""Price manifests (S6) and price rows (K4).

A manifest is one JSON document. It is read as whole text and parsed as a
VARIANT so validation (Q1) can tell a decimal string from a JSON number;
prices are exact DECIMALs, never floats.
"""

from __future__ import annotations

import json
import os
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_DIR = os.path.join(os.path.dirname(__file__), "..", "prices")

# Price types, and per provider the manifest, the official
# documentation host and the ``source`` label its prices are pinned to.
PRICE_TYPES = ["input", "cacheRead", "cacheCreation", "output"]
PROVIDERS = {
    "openai": {"manifest": "openai.json", "hostname": "developers.openai.com", "source": "codex"},
    "xai": {"manifest": "xai.json", "hostname": "docs.x.ai", "source": "grok_code"},
}
TIERS = ["standard", "standard_short_context"]
REQUIRED_FIELDS = ["model", "pricing_tier", "prices", "official_url", "verified_at",
                   "effective_from", "effective_to"]
COST_KIND = "api_estimate"

PRICE_SCHEMA = ("source string, model string, type string, price decimal(12,6), "
                "usd_per_token decimal(18,12), pricing_tier string, cost_kind string, "
                "effective_from date, effective_to date")


def manifest_path(provider: str) -> str:
    return os.path.normpath(os.path.join(PRICE_DIR, PROVIDERS[provider]["manifest"]))


def read_manifest_raw(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Whole manifest as one VARIANT row (NULL when not valid JSON)."""
    return (spark.read.text(path, wholetext=True)
            .select(F.lit(provider).alias("provider"),
                    F.try_parse_json("value").alias("doc")))


def read_price_manifest(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Manifest -> long price table, one row per priced (model, type);
    a type missing from ``prices`` yields no row."""
    raw = read_manifest_raw(spark, path, provider)
    models = raw.select("provider", F.explode(
        F.try_variant_get("doc", "$.models", "array<variant>")).alias("m"))
    per = models.select(
        F.lit(PROVIDERS[provider]["source"]).alias("source"),
        F.try_variant_get("m", "$.model", "string").alias("model"),
        F.try_variant_get("m", "$.pricing_tier", "string").alias("pricing_tier"),
        F.try_variant_get("m", "$.effective_from", "date").alias("effective_from"),
        F.try_variant_get("m", "$.effective_to", "date").alias("effective_to"),
        F.explode(F.try_variant_get("m", "$.prices", "map<string,string>")).alias("type", "raw"))
    price = F.col("raw").try_cast("decimal(12,6)")
    return per.where(F.col("type").isin(PRICE_TYPES)).select(
        "source", "model", "type", price.alias("price"),
        (price.cast("decimal(18,12)") / F.lit(1_000_000)).cast("decimal(18,12)").alias("usd_per_token"),
        "pricing_tier", F.lit(COST_KIND).alias("cost_kind"),
        "effective_from", "effective_to")


def price_rows(spark: SparkSession, providers=("openai", "xai")) -> DataFrame:
    """K4: the price dimension for every provider (a few dozen rows)."""
    out = None
    for p in providers:
        df = read_price_manifest(spark, manifest_path(p), p)
        out = df if out is None else out.unionByName(df)
    return out


def price_values(providers=("openai", "xai")) -> list[tuple]:
    """The same rows computed in plain Python (exact decimals), used to
    inline prices into oracle SQL and test fixtures."""
    rows = []
    for p in providers:
        with open(manifest_path(p), encoding="utf-8") as fh:
            doc = json.load(fh)
        for m in doc["models"]:
            for t, raw in m["prices"].items():
                if t in PRICE_TYPES:
                    d = Decimal(raw)
                    rows.append((PROVIDERS[p]["source"], m["model"], t, d,
                                 (d / Decimal(1_000_000)), m["pricing_tier"]))
    return rows
