"""What the training-data operators share: scratch tables, word rules, input access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and the white space that separates words, as Java (Spark) and RE2 (DuckDB) patterns.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch that goes to Python; long documents make larger defaults costly.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of the Arrow batches that Python workers get; a row larger than that is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def small_pages(spark: SparkSession) -> None:
    """Lets Parquet's writer compare a page with its size limit from the first row on, not only after 100 rows: of large rows,
    100 are a page of many megabytes, which is compressed in one piece outside the heap."""
    spark.conf.set("parquet.page.size.row.check.min", "1")


def give_back(spark: SparkSession) -> None:
    """Has all executors collect their garbage in full, after which a JVM returns the heap that former work filled; else it keeps
    it, beside Python workers and what the next stage needs outside the heap. One task per core reaches each idle executor."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: spark.checkpoint.dir. Where that is unset, a temporary one if all runs
    in one process (tests); on a cluster the setting is required, as executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="condensa-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/condensa-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so later steps survive lost executors and don't recompute it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._condensa_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing will read again."""
    path = getattr(df, "_condensa_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows of a side that may be broadcast after they were counted.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows. df should be persisted or read from a table."""
    return F.broadcast(df) if df.count() <= most else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a string, as a number that DuckDB can make too."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def remainder5(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
