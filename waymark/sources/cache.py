"""The match cache: matches by standardised input, one per key, kept with their algorithm version and time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.sources.store import CACHE_SCHEMA, ReadOnlyError, Store, upserted

VERSION, LEAST_SCORE = 20, 95


def from_events(events: DataFrame) -> DataFrame:
    """A cache-shaped view of an event stream, for reports and tests."""
    return events.select(
        F.concat(F.lit("K"), (F.col("event_id") % 500).cast("string")).alias("input_standardised"), F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("address_detail_pid"), (60 + F.col("event_id") % 41).cast("int").alias("total_score"),
        F.col("ts").cast("timestamp_ntz").alias("cached_at"), (18 + F.col("event_id") % 3).cast("int").alias("algorithm_version"),
    )


def latest(cache: DataFrame) -> DataFrame:
    """One entry per key: the newest, ties by the greatest pid."""
    w = Window.partitionBy("input_standardised").orderBy(F.col("cached_at").desc(), F.col("address_detail_pid").desc())
    return cache.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def window(cache: DataFrame, on: str | None = None, start: datetime | None = None, end: datetime | None = None, version: int | None = None, least: int | None = None) -> DataFrame:
    """Entries of a day, or from start to end inclusive; of a version; of a score or more."""
    if on is not None and (start is not None or end is not None):
        raise ValueError("give a day or a span, not both")
    if start is not None and end is not None and start > end:
        raise ValueError("start lies after end")
    for value, condition in ((on, lambda: F.to_date("cached_at") == F.lit(on).cast("date")), (start, lambda: F.col("cached_at") >= F.lit(start)), (end, lambda: F.col("cached_at") <= F.lit(end)), (version, lambda: F.col("algorithm_version") == version), (least, lambda: F.col("total_score") >= least)):
        if value is not None:
            cache = cache.where(condition())
    return cache


def lookup(inputs: DataFrame, cache: DataFrame, version: int = VERSION, least: int = LEAST_SCORE) -> DataFrame:
    """Inputs with their cached match."""
    return inputs.join(cache.where((F.col("algorithm_version") == version) & (F.col("total_score") >= least)), "input_standardised")


def history(cache: DataFrame, by: str = "day") -> DataFrame:
    if by not in ("day", "hour"):
        raise ValueError("by must be day or hour")
    return cache.groupBy(F.date_trunc(by, "cached_at").cast("timestamp_ntz").alias("bucket")).agg(
        F.count("*").alias("n"), F.min("total_score").alias("min_score"), F.round(F.avg("total_score"), 6).alias("mean_score"), F.max("total_score").alias("max_score")
    )


def status(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("n"), F.min("cached_at").alias("first_cached"), F.max("cached_at").alias("last_cached"))


def remember(store: Store, results: DataFrame, least: int = LEAST_SCORE) -> bool:
    """Keeps first-ranked matches of enough score; a read-only store is left alone without complaint."""
    names = [x.split()[0] for x in CACHE_SCHEMA.split(", ")]
    good = results.where((F.col("match_rank") == 1) & (F.col("total_score") >= least) & (F.col("match_basis") != "postcode_only") & F.col("input_standardised").isNotNull())
    rows = good.withColumns({"algorithm_version": F.lit(VERSION), "cached_at": F.current_timestamp()}).select(*names)
    try:
        store.put("match_cache", upserted(store.table("match_cache").select(*names), rows, ["input_standardised"]))
    except ReadOnlyError:
        return False
    return True


def clear(store: Store) -> None:
    store.put("match_cache", store.table("match_cache").limit(0))


def rollback(store: Store, after: datetime) -> None:
    """Forgets what was cached after a time."""
    store.put("match_cache", store.table("match_cache").where(F.col("cached_at") <= F.lit(after)))


def sample(cache: DataFrame, n: int, seed: int | None = None, **span) -> DataFrame:
    return window(cache, **span).orderBy(F.rand(seed)).limit(n)
