"""Structured texts made from the plain tables, the same in Spark and in DuckDB.

Each maker gives rows (doc_id, content). The SQL twins are keyed by the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to a few tasks per core: for work that is heavy per text, on tables of few files or uneven lengths."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _joined(rows: DataFrame, key: Column, line: Column, order: list[Column], glue: str = "\n", head: str = "", tail: str = "") -> DataFrame:
    said = rows.groupBy(key.cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line")))).alias("x"))
    return said.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r.line), glue), F.lit(tail)).alias("content"))


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long").cast("string")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per user."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "click", "DEBUG").otherwise("INFO")
    frame = F.when(F.col("event_type") == "error", F.concat(F.lit("\n    at handler("), F.col("event_id").cast("string"), F.lit(")\n  svc/main.go:"), (F.col("event_id") % 97).cast("string"))).otherwise("")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), kind, F.lit(" "), F.col("event_type"), F.lit(": value="), cents(F.col("value")), frame)
    return _joined(e, F.col("user_id"), line, [F.col("ts"), F.col("event_id")])


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pretty-printed JSON array of line items per order, with an optional and a nested member and a constant."""
    x = table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    note = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('  "note": "n'), s("l_linenumber"), F.lit('",\n'))).otherwise("")
    line = F.concat(
        F.lit('{\n  "part": '), s("l_partkey"), F.lit(',\n  "qty": '), F.col("l_quantity").cast("long").cast("string"), F.lit('.50,\n'), note, F.lit('  "flag": "'), F.col("l_returnflag"),
        F.lit('",\n  "meta": {"supp": '), s("l_suppkey"), F.lit(', "status": "'), F.col("l_linestatus"), F.lit('"},\n  "kind": "line"\n}'),
    )
    return _joined(x, F.col("l_orderkey"), line, [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")], ",\n", "[\n", "\n]")


def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One progress stream per nation: overwritten frames, then a coloured line."""
    n = table(spark, sf_dir, "nation")
    frames = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("Downloading "), F.col("n_name"), F.lit(" "), (i * 5).cast("string"), F.lit("% ▇"))), "\r")
    return n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(frames, F.lit("\n\n\n\n\x1b[32mdone\x1b[0m "), F.col("n_name"), F.lit(" \x1b]0;t\x07ok")).alias("content"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aligned table of customers per nation."""
    c = table(spark, sf_dir, "customer")
    line = F.concat(F.rpad(F.col("c_custkey").cast("string"), 10, " "), F.rpad("c_name", 24, " "), F.rpad("c_mktsegment", 14, " "), cents(F.col("c_acctbal")))
    return _joined(c, F.col("c_nationkey"), line, [F.col("c_custkey")])


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as numbered file reads."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 6, " "), F.lit("\t"), x))
    return d.select("doc_id", F.array_join(lines, "\n").alias("content"))


def greps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search result per brand."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("src/"), F.regexp_replace("p_type", " ", "_"), F.lit(".py:"), F.col("p_size").cast("string"), F.lit(":    "), F.col("p_name"))
    return _joined(p, F.crc32(F.col("p_brand").cast("binary")), line, [F.col("p_partkey")])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat request per conversation: doc_id, content (JSON body)."""
    c = table(spark, sf_dir, "conversations")
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    line = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","content":"'), text, F.lit('"}'))
    model = F.when(F.col("doc_id") % 3 == 0, "claude-opus-4-1-20250805").when(F.col("doc_id") % 3 == 1, "claude-sonnet-4-latest").otherwise("claude-haiku-3")
    body = _joined(c, F.col("conv_id"), line, [F.col("turn")], ",")
    return body.select("doc_id", F.concat(F.lit('{"model":"'), model, F.lit('","metadata":{"user_id":"u'), (F.col("doc_id") % 7).cast("string"), F.lit('"},"messages":['), F.col("content"), F.lit("]}")).alias("content"))


MAKERS = {"log": logs, "json": json_rows, "terminal": terminals, "tabular": tables, "search": greps}

SQL = {
    "logs": r"""SELECT user_id::BIGINT AS doc_id, string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END
      || ' ' || event_type || ': value=' || round(value * 100)::BIGINT::VARCHAR || CASE WHEN event_type = 'error' THEN chr(10) || '    at handler(' || event_id || ')' || chr(10) || '  svc/main.go:' || (event_id % 97) ELSE '' END,
      chr(10) ORDER BY ts, event_id) AS content FROM events GROUP BY user_id""",
    "terminals": r"""SELECT n_nationkey::BIGINT AS doc_id, (SELECT string_agg('Downloading ' || n_name || ' ' || (i * 5) || '% ▇', chr(13) ORDER BY i) FROM range(1, 21) t(i))
      || repeat(chr(10), 4) || chr(27) || '[32mdone' || chr(27) || '[0m ' || n_name || ' ' || chr(27) || ']0;t' || chr(7) || 'ok' AS content FROM nation""",
    "tables": r"""SELECT c_nationkey::BIGINT AS doc_id, string_agg(rpad(c_custkey::VARCHAR, 10, ' ') || rpad(c_name, 24, ' ') || rpad(c_mktsegment, 14, ' ') || round(c_acctbal * 100)::BIGINT, chr(10) ORDER BY c_custkey) AS content FROM customer GROUP BY c_nationkey""",
    "numbered": r"""SELECT doc_id, string_agg(lpad(pos::VARCHAR, 6, ' ') || chr(9) || line, chr(10) ORDER BY pos) AS content FROM
      (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) GROUP BY doc_id""",
    "requests": r"""SELECT conv_id AS doc_id, '{"model":"' || CASE conv_id % 3 WHEN 0 THEN 'claude-opus-4-1-20250805' WHEN 1 THEN 'claude-sonnet-4-latest' ELSE 'claude-haiku-3' END || '","metadata":{"user_id":"u' || (conv_id % 7) || '"},"messages":['
      || string_agg('{"role":"' || role || '","content":"' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"}', ',' ORDER BY turn) || ']}' AS content FROM conversations GROUP BY conv_id""",
}
