"""Line deduplication over range-partitioned line hashes, returning compressed keep bitmaps instead of text.

Every line long enough to matter becomes one row (128-bit hash of its key, doc_id, row print, position). The rows are
range-partitioned on (hash, doc_id descending, position), so a key that a third of all documents hold is spread over
many partitions, and sorted in that order. One streaming pass per partition sees the first occurrence of a key (the
largest doc_id) before the others and decides each key that lies within the partition. The first and the last key of a
partition may go on next door: for those the pass returns a count and its undecided rows, and a join with at most two
rows per partition settles them. Drops are gathered by document into zlib-compressed bitmaps.

Nulls: a null text is one empty line; null ids count as one document with the smallest id. Repeated rows with one
doc_id are one document and lose the same lines. An empty table gives an empty table; clashing columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

MIN_CHARS, MIN_DOCS = 20, 3
NO_ID = np.iinfo(np.int64).min
ROWS = 200_000  # of an output batch


def key_of(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def long_enough(key: bytes, least: int) -> bool:
    if len(key) < least or len(key) >= 4 * least:
        return len(key) >= least
    return len(key) - sum(0x80 <= b < 0xC0 for b in key) >= least


def _longs(pairs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(pairs), dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _line_rows(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            hashes, docs, prints, places = [], [], [], []

            def flush():
                h1, h2 = _longs(hashes)
                return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(docs, pa.int64()), pa.array(prints, pa.int64()), pa.array(places, pa.int32())], ["h1", "h2", "doc_id", "fp", "pos"])

            for doc, fp, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for pos, line in enumerate((text or b"").split(b"\n")):
                    if len(line) >= least and long_enough(key := key_of(line), least):
                        hashes.append(digest(key))
                        docs.append(doc)
                        prints.append(fp)
                        places.append(pos)
                if len(hashes) >= ROWS:
                    yield flush()
                    hashes, docs, prints, places = [], [], [], []
            if hashes:
                yield flush()

    return run


DROP, OPEN, SUMMARY = 0, 1, 2
DECIDED = "kind byte, h1 long, h2 long, doc_id long, fp long, pos int, docs long, last long, part int"


class _Stream:
    """Decides keys in one sorted pass; holds at most the lines of the second document of the current key."""

    def __init__(self, part: int, least: int):
        self.part, self.least, self.out = part, least, []
        self.key, self.first, self.docs, self.top, self.last, self.kept = None, True, 0, 0, 0, []

    def emit(self, kind: int, rows: np.ndarray, docs: int = 0, last: int = 0) -> None:
        if len(rows):
            n = len(rows)
            self.out.append((np.full(n, kind, np.int8), *rows.T[:4], rows[:, 4].astype(np.int32), np.full(n, docs), np.full(n, last), np.full(n, self.part, np.int32)))

    def close(self, at_end: bool) -> None:
        """The current key ends here, or with the partition."""
        if self.key is not None and (self.first or at_end):
            self.emit(SUMMARY, np.array([[*self.key, self.top, 0, 0]], dtype=np.int64), self.docs, self.last)
            for rows in self.kept:
                self.emit(OPEN, rows)
        self.kept = []
        self.first = self.first and self.key is None

    def feed(self, rows: np.ndarray, new_docs: int) -> None:
        """More rows of the current key."""
        self.docs += new_docs
        self.last = rows[-1, 2]
        if self.first:
            self.emit(OPEN, rows)
        elif self.docs >= self.least:
            for some in (*self.kept, rows):
                self.emit(DROP, some[some[:, 2] != self.top])
            self.kept = []
        else:
            self.kept.append(rows[rows[:, 2] != self.top])

    def batch(self, rows: np.ndarray) -> None:
        n = len(rows)
        new_key = np.ones(n, bool)
        new_key[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        new_key[0] = self.key != (rows[0, 0], rows[0, 1])
        new_doc = new_key.copy()
        new_doc[1:] |= rows[1:, 2] != rows[:-1, 2]
        if not new_key[0]:
            new_doc[0] = rows[0, 2] != self.last
        starts = np.flatnonzero(new_key)
        head = starts[0] if len(starts) else n
        if head:
            self.feed(rows[:head], int(new_doc[:head].sum()))
        if not len(starts):
            return
        # a key in the middle of the batch, whole and not the partition's first, is decided with its like at once
        middle = starts[:-1][1 if self.key is None else 0 :]
        if self.key is None and len(starts) > 1:
            self.start(rows, starts[0])
            self.feed(rows[starts[0] : starts[1]], int(new_doc[starts[0] : starts[1]].sum()))
        self.close(False)
        if len(middle):
            lo, hi = middle[0], starts[-1]
            counts = np.add.reduceat(new_doc[lo:hi].astype(np.int64), middle - lo)
            sizes = np.diff(np.append(middle, hi))
            tops = np.repeat(rows[middle, 2], sizes)
            mask = np.repeat(counts >= self.least, sizes) & (rows[lo:hi, 2] != tops)
            self.emit(DROP, rows[lo:hi][mask])
            self.first = False
        self.start(rows, starts[-1])
        self.feed(rows[starts[-1] :], int(new_doc[starts[-1] :].sum()))

    def start(self, rows: np.ndarray, i: int) -> None:
        self.key, self.docs, self.top, self.kept = (rows[i, 0], rows[i, 1]), 0, rows[i, 2], []

    def take(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        cols = [np.concatenate(c) for c in zip(*self.out, strict=True)]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "h1", "h2", "doc_id", "fp", "pos", "docs", "last", "part"])


def _decide(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = _Stream(TaskContext.get().partitionId(), least)
        for batch in batches:
            if batch.num_rows:
                stream.batch(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1))
                if (out := stream.take()) is not None:
                    yield out
        stream.close(True)
        if (out := stream.take()) is not None:
            yield out

    return run


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for places in batch.column(2).to_pylist():
            bits = np.zeros(max(places) + 1, bool)
            bits[places] = True
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "fp", "drops"])


def row_print(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.xxhash64("text").alias("fp"), F.col("text").cast("binary").alias("text"))


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id (null as the smallest long), fp (xxhash64 of the text) and drops: a zlib-compressed bitmap, bit i set where
    line i goes. Documents that lose nothing have no row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = row_print(docs).select("doc_id", "fp", "text").mapInArrow(_line_rows(min_chars), "h1 long, h2 long, doc_id long, fp long, pos int")
    rows = materialize(rows, "line-rows")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("pos"), F.col("fp")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS // 4))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_decide(min_docs), DECIDED)
    dealt = materialize(dealt, "line-decided")
    small_batches(spark)
    along = Window.partitionBy("h1", "h2").orderBy("part")
    seams = dealt.filter(F.col("kind") == SUMMARY).withColumn("again", (F.lag("last").over(along) == F.col("doc_id")).cast("long"))
    seams = seams.groupBy("h1", "h2").agg((F.sum("docs") - F.coalesce(F.sum("again"), F.lit(0))).alias("n"), F.max("doc_id").alias("top")).filter(F.col("n") >= min_docs)
    late = dealt.filter(F.col("kind") == OPEN).join(F.broadcast(seams), ["h1", "h2"]).filter(F.col("doc_id") != F.col("top"))
    drops = dealt.filter(F.col("kind") == DROP).select("doc_id", "fp", "pos").unionByName(late.select("doc_id", "fp", "pos"))
    return drops.groupBy("doc_id", "fp").agg(F.collect_list("pos").alias("places")).mapInArrow(_bitmaps, "doc_id long, fp long, drops binary")


def kept_lines(text: bytes | None, drops: bytes | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and what is left of a text."""
    text = text or b""
    if not drops:
        return text.count(b"\n") + 1, 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(drops), np.uint8))
    lines = text.split(b"\n")
    left = [x for i, x in enumerate(lines) if i >= len(bits) or not bits[i]]
    return len(lines), len(lines) - len(left), b"\n".join(left)


def with_drops(docs: DataFrame) -> DataFrame:
    """doc_id, text (binary) and drops of every row of docs."""
    rows, maps = row_print(docs), drop_bitmaps(docs)
    return rows.join(maps, ["doc_id", "fp"], "left").select(F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "text", "drops")


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = [kept_lines(t, d)[2].decode() for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], ["doc_id", "text"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left."""
    return with_drops(docs).mapInArrow(_texts, "doc_id long, text string")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [kept_lines(t, d) for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found])],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_drops(docs).mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, g.top IS NOT NULL AND k.doc_id <> g.top AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
