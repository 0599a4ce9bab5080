"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are normalised (lower case; each run of characters that are not letters or digits is one space). An item
of m characters that occurs with at most k edits keeps at least m + 1 - q - k*q of its q-grams in the region, on
diagonals (text position minus item position) that differ by at most k. So the shared q-grams are counted in diagonal
bands of width 2*(k+1) that overlap by half; a band with enough of them is a region, and a region counts as found if a
banded semi-global alignment of the whole item costs at most k edits. k is edit_rate * m, lowered for short items until
the lemma asks for at least one q-gram. Items that so have no budget (fewer than 2q normalised characters, those shorter
than a q-gram included) are looked for as they are, by an automaton of all of them, and count where they stand as whole
words; next to a character of a script without spaces any place counts. Items without a letter or digit match nothing.

The benchmark is a stated query set: it is read in blocks of about BLOCK_CHARS characters, dealt by a hash, and each block
goes through the documents in one pass, without a shuffle.

Nulls: null and empty texts match nothing; null ids come back as null. Repeated rows are searched each. An empty table
(either one) gives no match. Clashing and other columns are not read by find_leaks() and pass through decontaminate().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

Q, EDIT_RATE, BLOCK_CHARS = 8, 0.1, 4_000_000
BITS = 22
STRETCH = 1_000_000  # characters of a text that are looked up at once
MEETINGS = 1 << 20  # places of shared q-grams that are counted at once
#: Code point ranges of scripts that are written without spaces between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
BASE, MIX, WORD64 = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), 2**64

_alnum: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alnum
    if _alnum is None:
        _alnum = np.array([chr(c).isalnum() for c in range(0x110000)])
    return _alnum


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals have longer small forms
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    good = _letters()[codes]
    keep = good.copy()
    keep[1:] |= good[:-1]
    places = np.flatnonzero(keep)
    out = np.where(good[places], codes[places], np.uint32(32))
    if len(out) and out[-1] == 32:
        return out[:-1], places[:-1]
    return out, places


def q_grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram (q = 8), by doubling."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    h = codes.astype(np.uint64) + np.uint64(1)
    base = BASE
    for step in (1, 2, 4):
        h = h[:-step] * np.uint64(base) + h[step:]
        h ^= h >> np.uint64(29)
        base = (base * int(MIX) | 1) % WORD64
    return h


def fours(codes: np.ndarray) -> np.ndarray:
    """The 4-grams, hashed; a clash only lets a region through."""
    c = codes.astype(np.int64)
    return ((c[:-3] * 8191 + c[1:-2]) * 8191 + c[2:-1]) * 8191 + c[3:] if len(c) > 3 else c[:0]


def cells(h: np.ndarray) -> np.ndarray:
    return ((h * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The cheapest alignment of the whole item with a part of the text on diagonals low .. high: (edits, start, end), or
    None beyond k edits. Cell (i, d) ends after i item characters on diagonal d."""
    m, n, width = len(item), len(text), high - low + 1
    region, first = text[max(0, low) : max(0, high + m)], max(0, low)
    at = region.tobytes().find(item.tobytes())
    while at >= 0 and at % item.itemsize:
        at = region.tobytes().find(item.tobytes(), at + 1)
    if at >= 0:
        return 0, first + at // item.itemsize, first + at // item.itemsize + m
    big = k + 1
    diagonals = np.arange(low, high + 1)
    cost = np.where((diagonals >= 0) & (diagonals <= n), 0, big)
    start = diagonals.copy()
    steps = np.arange(width)
    for i in range(1, m + 1):
        j = diagonals + i - 1  # the text character that a diagonal step reads
        inside = (j >= 0) & (j < n)
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == item[i - 1]
        new = np.where(inside, cost + ~same, big)
        origin = start
        skip = np.append(cost[1:], big) + 1  # an item character without a text character: from the diagonal above
        better = skip < new
        new = np.where(better, skip, new)
        origin = np.where(better, np.append(start[1:], 0), origin)
        # a text character without an item character: along the row, from lower diagonals
        flat = new - steps
        best = np.minimum.accumulate(flat)
        at = np.maximum.accumulate(np.where(flat == best, steps, 0))
        cost = np.minimum(best + steps, big)
        start = origin[at]
        if cost.min() > k:
            return None
    ends = np.where((diagonals + m >= 0) & (diagonals + m <= n), cost, big)
    d = int(np.argmin(ends))
    return (int(ends[d]), int(start[d]), int(diagonals[d]) + m) if ends[d] <= k else None


def joined(left: str, right: str) -> bool:
    """Whether two neighbours belong to one word."""
    return left != " " and right != " " and not any(low <= ord(c) <= high for c in (left, right) for low, high in UNSPACED)


class Index:
    """The q-grams of a block of items, and the search of one text for all of them."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float):
        texts: dict[bytes, list] = {}
        for item, text in items:
            codes = normalise(text or "")[0]
            if len(codes):
                texts.setdefault(codes.tobytes(), [codes, []])[1].append(item)
        strict = lambda x: min(int(edit_rate * len(x[0])), (len(x[0]) - Q) // Q) <= 0
        self.items = [x for x in texts.values() if not strict(x)]
        self.strict = ahocorasick.Automaton()
        for codes, ids in texts.values():
            if strict((codes, ids)):
                self.strict.add_word(codes.tobytes().decode("utf-32-le"), (len(codes), ids))
        self.strict.make_automaton()
        self.budget, self.need, grams, owners, offsets = [], [], [], [], []
        for n, (codes, _) in enumerate(self.items):
            m = len(codes)
            k = min(int(edit_rate * m), (m - Q) // Q)
            self.budget.append(k)
            self.need.append(m + 1 - Q - k * Q)
            grams.append(q_grams(codes))
            owners.append(np.full(m + 1 - Q, n))
            offsets.append(np.arange(m + 1 - Q))
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.owner = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.offset = np.concatenate(offsets)[order] if owners else np.zeros(0, np.int64)
        self.budget, self.need = np.array(self.budget, np.int64), np.array(self.need, np.int64)
        self.longest = max((len(c) for c, _ in self.items), default=0)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[cells(self.grams)] = True

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) for the cheapest place of each item found; places are in the text as given."""
        if not text:
            return []
        codes, places = normalise(text)
        out = sorted((item, 0, a, b) for a, b, ids in self._as_they_are(codes) for item in ids) if len(self.strict) else []
        best: dict[int, tuple[int, int, int]] = {}
        over = 2 * self.longest + 2 * Q
        for at in range(0, max(len(codes) - Q + 1, 0), STRETCH):
            for n, edits, a, b in self._stretch(codes[at : at + STRETCH + over]):
                if n not in best or edits < best[n][0]:
                    best[n] = edits, at + a, at + b
        out += [(item, edits, a, b) for n, (edits, a, b) in sorted(best.items()) for item in self.items[n][1]]
        return [(item, edits, int(places[a]), int(places[b - 1]) + 1 if b > a else int(places[a])) for item, edits, a, b in out]

    def _as_they_are(self, codes: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(start, end, item ids) of the first place of each item without a budget."""
        said, found = codes.tobytes().decode("utf-32-le"), {}
        for last, (m, ids) in self.strict.iter(said):
            a, b = last + 1 - m, last + 1
            if ids[0] not in found and not (a and joined(said[a - 1], said[a])) and not (b < len(said) and joined(said[b - 1], said[b])):
                found[ids[0]] = a, b, ids
        return list(found.values())

    def _likely(self, item: int, region: np.ndarray, k: int) -> bool:
        """The lemma for q = 4, without places."""
        codes = self.items[item][0]
        need = len(codes) - 3 - 4 * k
        return need <= 0 or int(np.isin(fours(codes), fours(region)).sum()) >= need

    def _stretch(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        h = q_grams(codes)
        hits = np.flatnonzero(self.seen[cells(h)])
        found = np.searchsorted(self.grams, h[hits])
        found[found == len(self.grams)] = 0
        real = self.grams[found] == h[hits]
        hits, found = hits[real], found[real]
        if not len(hits):
            return
        span = np.int64(len(codes) + 2 * self.longest + 4)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        places = np.cumsum(self.count[found])
        for some in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(places // MEETINGS)) + 1):
            counts = self.count[found[some]]
            where = np.repeat(self.first[found[some]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            owner = self.owner[where]
            diagonal = np.repeat(hits[some], counts) - self.offset[where] + self.longest
            held.append(np.unique(owner * span + diagonal // (self.budget[owner] + 1), return_counts=True))
        bands, n = held[0]
        if len(held) > 1:
            bands, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
        # band b has the hits of half-bands b and b + 1
        after = np.append((bands[1:] == bands[:-1] + 1) * n[1:], 0)
        before = np.insert((bands[1:] == bands[:-1] + 1) * n[:-1], 0, 0)
        for some, total in ((bands, n + after), (bands[before == 0] - 1, n[before == 0])):
            for b in some[total >= self.need[some // span]].tolist():
                item, b = divmod(b, int(span))
                k = int(self.budget[item])
                low = b * (k + 1) - self.longest
                if not self._likely(item, codes[max(0, low - k) : low + 2 * (k + 1) + k + len(self.items[item][0])], k):
                    continue
                if (match := aligned(self.items[item][0], codes, low - k, low + 2 * (k + 1) - 1 + k, k)) is not None:
                    yield item, *match


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about that many characters; an item larger than a block makes its block larger."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = 1 if total <= block_chars else -(-2 * total // block_chars)
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, start, end (code points of the text as given)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    kinds, names = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], ["doc_id", "item_id", "edits", "start", "end"]
    out = None
    for items in _blocks(benchmark, block_chars):

        def run(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, edit_rate)
            for batch in batches:
                found = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in index.find(text)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        part = rows.mapInArrow(run, "doc_id long, item_id long, edits int, start long, end long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for items in _blocks(benchmark, block_chars):

        def run(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, edit_rate)
            for batch in batches:
                yield batch.filter(pa.array([not index.find(text) for text in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
