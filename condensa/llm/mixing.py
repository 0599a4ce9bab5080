"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (the source's target over its size). The copies are
prefix-summed along the documents of the source, one random offset is added, and a document is emitted once for each
integer boundary that its stretch crosses. The documents stand in order of size, so what is taken follows the target
within about the size of one document, whatever the offset.

The rank behind the prefix sum is found in two levels: rows are range-partitioned on (source, size, hash), counted by
partition and source, and ranked inside those slices. So a source with a third of all rows is spread over many tasks.

Nulls: a null text has size 0; null is a source of its own, last in order; a null doc_id is hashed as an empty text.
Sources without words have target 0 and are never emitted. Repeated rows are sampled one by one. An empty table gives
an empty table. Other columns are not read by sample_copies() and pass through mix() whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hex32, materialize, small, small_batches, table, unused

OFFSET_BITS = 2**32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """From rows (source, size): one row per source with source_size and target.

    weights repeat along the sources in code point order, null last. The targets share share[0]/share[1] of all sizes by
    weight; none exceeds most times its source's size, and what is cut is shared again. Sources fill up in the order of
    size over weight, so one sorted pass settles it. Integers are kept until the last division."""
    num, den = share
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")).cast("long")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, whole = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    per = per.withColumns({
        "_all": F.sum("source_size").over(whole),
        "_full": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most,
        "_w": F.sum("w").over(after),
    })
    full = F.col("w") * (num * F.col("_all") - den * F.col("_full")) >= den * F.col("_w") * most * F.col("source_size")
    per = per.withColumn("_stop", full).withColumns({
        "_cut": F.sum(F.when(F.col("_stop"), most * F.col("source_size")).otherwise(0)).over(whole),
        "_left": F.sum(F.when(F.col("_stop"), 0).otherwise(F.col("w"))).over(whole),
    })
    target = F.when(F.col("_stop"), (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("w") * (num * F.col("_all") - den * F.col("_cut"))).cast("double") / (den * F.col("_left")).cast("double")
    )
    return per.select("source", "source_size", target.alias("target"))


def sample_copies(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: keys, source, size, source_size, target and copies. docs needs doc_id, source, text."""
    spark = docs.sparkSession
    more = [k for k in keys if k != "doc_id"]
    order = hex32(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", *more, "source", word_count(F.col("text")).alias("size"), order.alias("_h")).persist()  # a plain scan: what is lost is read again
    by = [F.col("source").asc_nulls_last(), F.col("size"), F.col("_h"), F.col("doc_id")]
    ranged = materialize(rows.repartitionByRange(*by).withColumn("_slice", F.spark_partition_id()), "mix-ranged")
    slices = ranged.groupBy("source", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "_slice", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    targets = source_targets(rows, weights, share, most)
    offset = hex32(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("\u0000")))) / F.lit(float(OFFSET_BITS))
    plan = slices.join(targets, slices["source"].eqNullSafe(targets["source"])).select(
        slices["source"].alias("_source"), F.col("_slice").alias("_part"), "_before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "_slice").orderBy("size", "_h", "doc_id")
    ranked = ranged.withColumn("_k", F.row_number().over(inside).cast("long"))
    out = ranked.join(plan, ranked["source"].eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_part")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k = F.col("_before") + F.col("_k")
    crossed = F.floor(offset + rate * k) - F.floor(offset + rate * (k - 1))
    return out.select(*keys, "source", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: each document as many times as it is taken, with the columns of docs.

    Texts are shuffled once, to their number of copies. Rows that agree in all columns are told apart by a running number, so
    repeated rows keep their own draws; only such rows are numbered."""
    small_batches(docs.sparkSession)
    fp, j, copy, i, f, k, times = unused(docs, "_fp", "_j", "_copy", "_i", "_f", "_k", "_times")
    named = docs.withColumn(fp, F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]))
    copies = sample_copies(named.select("doc_id", "source", "text", F.col(fp).alias("_fp")), weights, share, most, seed, ("doc_id", "_fp"))
    copies = materialize(copies.select(F.col("doc_id").alias(i), F.col("_fp").alias(f), F.col("copies").alias(times)), "mix-copies")
    again = materialize(copies.groupBy(i, f).agg(F.count(F.lit(1)).alias(k)).filter(F.col(k) > 1).drop(k), "mix-repeated")
    same = named["doc_id"].eqNullSafe(F.col(i)) & (named[fp] == F.col(f))
    if again.isEmpty():
        out = named.join(copies.filter(F.col(times) > 0), same)
    else:
        pair = copies[i].eqNullSafe(again[i]) & (copies[f] == again[f])
        out = named.join(copies.join(small(again), pair, "left_anti").filter(F.col(times) > 0), same)
        numbered = named.join(small(again), same, "left_semi").withColumn(j, F.row_number().over(Window.partitionBy("doc_id", fp).orderBy(F.lit(0))))
        draws = copies.join(small(again), pair, "left_semi").withColumn(k, F.row_number().over(Window.partitionBy(i, f).orderBy(times)))
        more = numbered.join(draws, numbered["doc_id"].eqNullSafe(F.col(i)) & (numbered[fp] == F.col(f)) & (F.col(j) == F.col(k))).filter(F.col(times) > 0)
        out = out.select(*docs.columns, times).unionByName(more.select(*docs.columns, times))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = sample_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS w FROM s),
f AS (SELECT *, sum(source_size) OVER ()::BIGINT AS tot,
        2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fullb,
        sum(w) OVER (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS wa FROM w),
g AS (SELECT *, w * (3 * tot - 2 * fullb) >= 2 * wa * 2 * source_size AS stop FROM f),
h AS (SELECT *, sum(CASE WHEN stop THEN 2 * source_size ELSE 0 END) OVER ()::BIGINT AS cut, sum(CASE WHEN stop THEN 0 ELSE w END) OVER ()::BIGINT AS lft FROM g),
t AS (SELECT source, source_size, CASE WHEN stop THEN (2 * source_size)::DOUBLE ELSE (w * (3 * tot - 2 * cut))::DOUBLE / (2 * lft)::DOUBLE END AS target,
        ('0x' || substr(md5('mix|' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM h),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * least(floor(u + rate * k) - floor(u + rate * (k - 1)), 2))::BIGINT AS taken FROM r
"""
