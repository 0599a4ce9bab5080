"""Exact deduplication: deduplicate locally, merge salted digest groups, combine the salt winners globally.

The key of every stage is (digest, whole normalised text), so content is compared in full each time and two texts with
the same digest stay apart. Stage one's map side is the local deduplication; its groups carry a salt made from the
document id, so copies that fill a third of the table meet in many tasks; stage two combines at most SALTS winners of a
text. Only digests, ids and counts go on from there. If some digest stands for several texts, its rows are joined on
the whole text instead (see members()).

DataFrame functions only; no Python runs on the executors.

Nulls: a null text counts as empty; a null doc_id is kept only if the whole group has none. Repeated rows count each.
An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, materialize, table, unused

SALTS = 8
#: A group is hot from this share of all rows; at most 1 / HOT groups can be, so their list has a proven size.
HOT = 0.001


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def winners(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """From rows (doc_id, norm): one row (digest, norm, keep_id, group_size) per distinct text."""
    salted = docs.groupBy(digest(F.col("norm")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "norm")
    merged = salted.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return merged.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined to one row of groups each. Hot groups (over HOT of all rows) are few by count and are broadcast; what is
    left has no large group and is shuffled."""
    hot = groups.filter(F.col("group_size") > F.lit(max(1.0, total * HOT)))
    found = rows.join(F.broadcast(hot), on, "left")
    rest = found.filter(F.col("group_size").isNull()).select(*rows.columns).join(groups, on)
    return found.filter(F.col("group_size").isNotNull()).unionByName(rest)


def lookup_join(rows: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """spread_join() for groups that are persisted: a counted small side is broadcast as a whole."""
    few = groups.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(groups), on) if few else spread_join(rows, groups, on, total)


def members(docs: DataFrame, digest: Callable[[Column], Column] = lambda c: F.unhex(F.sha2(c, 256))) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size and kept. docs needs doc_id and text."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    ids = materialize(norm.select("doc_id", digest(F.col("norm")).alias("digest")), "exact-ids")
    per = winners(norm, digest).select("digest", F.octet_length("norm").alias("_len"), "keep_id", "group_size")
    groups = materialize(per, "exact-groups")
    shared = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("digest")
    if shared.isEmpty():
        out = spread_join(ids, groups.drop("_len"), ["digest"], ids.count())
    else:
        apart = materialize(shared, "exact-collisions")
        plain = groups.join(apart, "digest", "left_anti").drop("_len")
        alone = ids.join(apart, "digest", "left_anti")
        both = norm.withColumn("digest", digest(F.col("norm"))).join(apart, "digest", "left_semi")
        exact = both.join(winners(both.select("doc_id", "norm"), digest), ["digest", "norm"]).select("digest", "doc_id", "keep_id", "group_size")
        out = spread_join(alone, plain, ["digest"], ids.count()).unionByName(exact)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()))


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = lambda c: F.unhex(F.sha2(c, 256))) -> DataFrame:
    """docs without the rows whose text a smaller doc_id has too; all columns stay. A row is judged by its id and its text, so
    an id that lost with one text may stay with another; rows that repeat both stay together; a null id stays where its
    group has no other."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    groups = materialize(winners(norm, digest).select("digest", "norm", "keep_id"), "exact-winners")
    several = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("digest")
    n, d = unused(docs, "_norm", "_digest")
    named = docs.withColumn(n, normalised(F.col("text"))).withColumn(d, digest(F.col(n)))
    groups = groups.select(*[F.col(c).alias(f"_kept_{c}__") for c in groups.columns])
    same = (named[d] == F.col("_kept_digest__")) & named["doc_id"].eqNullSafe(F.col("_kept_keep_id__"))
    same = same if several.isEmpty() else same & (named[n] == F.col("_kept_norm__"))
    return named.join(groups, same, "left_semi").select(*docs.columns)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    out = members(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM d
"""
