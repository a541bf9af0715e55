"""A registry of feeds: replaced by key, checked for coverage of a date and for drift of a file's hash; and version names."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The registry with rows put in place of those of the same key."""
    return registry.join(rows.select(key), key, "left_anti").unionByName(rows)


def uncovered(registry: DataFrame, day: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Feeds whose validity does not hold the day."""
    return registry.filter(~F.lit(day).between(F.col(start), F.col(end)))


def drifted(registry: DataFrame, now: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """Feeds whose file has another hash than is registered."""
    return registry.join(now.select(key, F.col(digest).alias("_now")), key).filter(~F.col(digest).eqNullSafe(F.col("_now"))).drop("_now")


def network_version(name: str, hashes: list[str]) -> str:
    return f"{name}-{hashlib.sha256('\n'.join(sorted(hashes)).encode()).hexdigest()[:10]}"


def chain_hash(spec_hashes: list[str], feed_hashes: list[str]) -> str:
    return hashlib.sha256(json.dumps([spec_hashes, sorted(feed_hashes)]).encode()).hexdigest()[:12]


def chunk_key(settings: dict, inputs: list[str]) -> str:
    return hashlib.sha256(json.dumps([settings, sorted(inputs)], sort_keys=True).encode()).hexdigest()


def replace_version(df: DataFrame, path: str, column: str) -> None:
    """Writes a version's rows over that version alone, by dynamic partition overwrite."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
