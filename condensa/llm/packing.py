"""Token-ID output: tokenised documents packed into fixed-length rows by best-fit decreasing.

Every task tokenises its documents, splits each into pieces of at most seq_len tokens (pieces in order give the document
back, token for token), and packs the pieces block by block: pieces in decreasing length, each put into the fullest row
that still holds it. A segment tree over free capacities (0 .. seq_len) finds that row in log(seq_len) steps. A block
is a bounded number of tokens, so memory doesn't grow with the input, and nothing is shuffled. A row is most of a
megabyte, so Parquet's writer is told to look at the size of its pages after each row, see small_pages().

A result row is one id matrix: ids (rows x seq_len, little-endian, row-major; pad where no segment lies), the cumulative
segment lengths cu_seqlens (per matrix, flat offsets; the padding at the end of a row is a segment with doc index -1),
and position_ids, which restart at 0 at each segment. doc_ids, pieces and starts say which tokens a segment holds.

Nulls: null and empty texts are the document separator alone (eos), so no document vanishes; null ids stay null. Repeated
rows are packed each. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, small_pages, table

SEQ_LEN, MATRIX_ROWS, BLOCK_TOKENS = 2048, 64, 2_000_000
SCHEMA = "part int, matrix int, n_rows int, seq_len int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, pieces array<int>, starts array<bigint>"


class Capacities:
    """Segment tree over the free capacities 0 .. size: which smallest capacity of at least n has a row."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = self.leaves + free
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (free, row) of the fullest row that has room for need."""
        i = self.leaves + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return free, self.rows[free].pop()


def best_fit(lengths: np.ndarray, seq_len: int) -> list[list[int]]:
    """Rows as lists of piece numbers, for lengths of 1 .. seq_len."""
    tree, rows = Capacities(seq_len), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = tree.take(need)
        if found is None:
            found = seq_len, len(rows)
            rows.append([])
        rows[found[1]].append(piece)
        if found[0] > need:
            tree.put(found[0] - need, found[1])
    return rows


def _matrices(block: list[tuple], seq_len: int, matrix_rows: int, pad: int, dtype: str, part: int, at: int) -> Iterator[tuple]:
    """block: (doc_id, piece number, first token, ids)."""
    rows = best_fit(np.array([len(p[3]) for p in block]), seq_len)
    for k in range(0, len(rows), matrix_rows):
        some = rows[k : k + matrix_rows]
        ids = np.full((len(some), seq_len), pad, dtype)
        positions = np.zeros((len(some), seq_len), "<i4")
        cu, docs, pieces, starts = [0], [], [], []
        for r, members in enumerate(some):
            used = 0
            for m in members:
                doc, piece, start, tokens = block[m]
                n = len(tokens)
                ids[r, used : used + n] = tokens
                positions[r, used : used + n] = np.arange(n)
                used += n
                cu.append(r * seq_len + used)
                docs.append(doc)
                pieces.append(piece)
                starts.append(start)
            if used < seq_len:
                positions[r, used:] = np.arange(seq_len - used)
                cu.append((r + 1) * seq_len)
                docs.append(None)
                pieces.append(-1)
                starts.append(-1)
        yield part, at, len(some), seq_len, ids.tobytes(), cu, positions.tobytes(), docs, pieces, starts
        at += 1


def tiktoken_encoder(path: str | None = None):
    """Encoder from a ranks file; the default is the public 50k byte-level vocabulary. Returns (encode, eos, n_vocab)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, len(ranks), len(ranks) + 1


#: tiktoken may recurse or slow down over giant words; whole texts are fed in stretches cut at a space before a word.
STRETCH = 200_000


def stretches(text: str) -> Iterator[str]:
    """Cuts a long text where the tokeniser's own pattern always cuts: between a letter and the space before the next."""
    at = 0
    while len(text) - at > STRETCH:
        cut = text.rfind(" ", at + 1, at + STRETCH)
        while cut > at and not (text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            cut = text.find(" ", at + STRETCH)
            while cut > 0 and cut + 1 < len(text) and not (text[cut - 1].isalpha() and text[cut + 1].isalpha()):
                cut = text.find(" ", cut + 1)
            if cut <= 0 or cut + 1 >= len(text):
                break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _pack(seq_len: int, matrix_rows: int, block_tokens: int, encoder):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, eos, n_vocab = encoder()
        dtype = "<u2" if n_vocab <= 2**16 else "<i4"
        part, at, block, held = TaskContext.get().partitionId(), 0, [], 0
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

        def flush():
            nonlocal at, block, held
            for one in _matrices(block, seq_len, matrix_rows, eos, dtype, part, at):
                at += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names)
            block, held = [], 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = [np.array(encode(s), dtype) for s in stretches(text or "")]
                ids = np.concatenate([*pieces, np.array([eos], dtype)])
                for k, start in enumerate(range(0, len(ids), seq_len)):
                    block.append((doc, k, start, ids[start : start + seq_len]))
                    held += len(block[-1][3])
                    if held >= block_tokens:
                        yield from flush()
        if block:
            yield from flush()

    return run


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, matrix_rows: int = MATRIX_ROWS, block_tokens: int = BLOCK_TOKENS, encoder=tiktoken_encoder) -> DataFrame:
    """docs needs doc_id and text. Result: see SCHEMA and the head of this module; (part, matrix) names a matrix."""
    small_batches(docs.sparkSession)
    small_pages(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(seq_len, matrix_rows, block_tokens, encoder), SCHEMA)


def op9_pack_tokens(spark, sf_dir: str) -> DataFrame:
    """The packed id matrices of all documents."""
    return pack(table(spark, sf_dir, "documents"))
