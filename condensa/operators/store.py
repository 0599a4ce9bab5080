"""A content-addressed store of originals as tables: aliases by first sight, eviction by age and size, lookup by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

TTL_SECONDS, MAX_BYTES = 24 * 3600, 256 * 2**20


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def running(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the sum of value over all rows up to this one, in an order that no two rows share: sums inside range partitions,
    and what the partitions before hold, one row per partition."""
    ranged = written(df.repartitionByRange(*order).withColumns({"_slice": F.spark_partition_id(), "_value": value.cast("long")}), "store-ranged")
    slices = ranged.groupBy("_slice").agg(F.sum("_value").alias("_n"))
    # as many rows as a shuffle has partitions
    before = slices.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.sum("_value").over(Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("_inside", inside).join(F.broadcast(before), "_slice")
    return found.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(out))


def put(arrivals: DataFrame, store: DataFrame | None = None, content: str = "content", at: str = "stored_at") -> DataFrame:
    """alias, hash, content, stored_at and size of every distinct content: known ones keep their alias and time, new ones get
    the next aliases in order of arrival. Aliases are never given again."""
    first = arrivals.groupBy(content_hash(F.col(content)).alias("hash")).agg(F.min_by(content, at).alias("content"), F.min(at).alias("stored_at"))
    if store is None:
        known, last = None, 0
    else:
        known = store.select("alias", "hash", "content", "stored_at", "size")
        first = first.join(store.select("hash"), "hash", "left_anti")
        last = store.agg(F.max("alias")).first()[0] or 0
    ranks = running(first.select("hash", "stored_at"), [F.col("stored_at").asc(), F.col("hash").asc()], F.lit(1), "_rank").select("hash", "_rank")
    new = first.join(ranks, "hash").select((F.lit(last) + F.col("_rank")).cast("long").alias("alias"), "hash", "content", "stored_at", F.octet_length("content").cast("long").alias("size"))
    return new if known is None else known.unionByName(new)


def evict(store: DataFrame, now: Column, ttl: int = TTL_SECONDS, most: int = MAX_BYTES) -> DataFrame:
    """Without what is expired, and without the oldest beyond the size cap."""
    held = running(store.select("alias", "stored_at", "size"), [F.col("stored_at").desc(), F.col("alias").desc()], F.col("size"), "_held")
    fresh = F.unix_timestamp(now) - F.unix_timestamp(F.col("stored_at").cast("timestamp")) <= ttl
    return store.join(held.filter(fresh & (F.col("_held") <= most)).select("alias"), "alias", "left_semi").select(*store.columns)


def get(wanted: DataFrame, store: DataFrame, alias: str = "id") -> DataFrame:
    """Adds content and status (found or expired) to requests whose id is a number or a numeric string."""
    key = F.expr(f"try_cast(`{alias}` AS BIGINT)")
    out = wanted.withColumn("_k", key).join(store.select(F.col("alias").alias("_k"), "content"), "_k", "left")
    return out.select(*wanted.columns, "content", F.when(F.col("content").isNull(), "expired").otherwise("found").alias("status"))
