"""MinHash near-deduplication: universal hash minima, banding, signature check, full check, star components.

1. One pass over the texts gives each document its number of distinct word shingles, a digest of the whole set, and a
   signature: HASHES minima of multiply-add hashes of the 64-bit shingle hashes.
2. Documents with equal sets form a class (pre-aggregated, so groups of copies collapse before anything else); the
   smallest doc_id stands for it.
3. Signatures are cut into bands. Two sets of similarity 0.8 agree in at least one of 45 bands of 6 rows with
   probability 1 - 1e-6, more similar ones more surely; unlike sets seldom do, however many there are.
4. A bucket first yields the pairs of one pivot with each other member. Where that leaves much to compare, more such
   rounds follow, with drawn members of each bucket's largest component, as long as they halve what is left.
5. Then every bucket whose members still lie in several components is settled: all its members outside its largest
   component are compared with every member of other components. Narrow buckets (at most NARROW members) give the pairs
   that signatures allow. Wide buckets are cut into cells of a bounded number of members and shingles; a task gets two
   cells with their full sets, confirms the pairs of other components there and returns a spanning forest of the links.
   So no bucket is capped, skipped or thinned, and the rows made grow in proportion to the members of buckets.
6. Pairs whose sizes or signatures rule the threshold out go (an agreement 4.5 standard deviations too low); the others
   are confirmed on the full sets.
7. Links become components by large-star and small-star.

Nulls: a null or empty text has no shingles and is linked with nothing; a row with a null doc_id is linked with nothing,
has a null component and is kept. Rows that share a doc_id are one document: each of their texts counts for it, and they
are in one component. Very long texts are read whole. An empty table gives an empty table; clashing and other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small, small_batches, table
from .exact import lookup_join, spread_join
from .graph import components

BANDS, BAND_ROWS = 45, 6
HASHES = BANDS * BAND_ROWS
#: Hashes of a signature whose lowest bytes are kept for the signature check.
CHECKED = HASHES
PERCENT, SHINGLE = 80, 5
#: Members of a narrow bucket; members and shingles of a cell of a wide one; columns of a cell's matrix at a time.
NARROW, CELL, CELL_SHINGLES, COLUMNS = 32, 512, 1 << 19, 4096
#: Comparisons for each document beyond which another round of pivots comes before buckets are settled.
WORK = 1000
#: Pairs of many narrow buckets whose signatures are compared at a time.
MEETINGS = 1 << 17
#: Documents whose signatures (about 300 bytes each) may be broadcast.
SMALL_SIGNED = 25_000
CACHE_WORDS = 300_000
CHUNK = 1 << 15

_draws = np.random.Generator(np.random.PCG64(20240607))
FACTORS = _draws.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draws.integers(0, 2**64, HASHES, dtype=np.uint64)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; with fewer words, of all its words as one."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    rows = h[:n].copy()
    for k in range(1, min(size, len(words))):
        rows *= STEP
        rows += h[k : k + n]
        rows ^= rows >> np.uint64(31)
    rows *= MIX
    rows ^= rows >> np.uint64(32)
    return np.unique(rows)


def signature_rows(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES 32-bit minima of each non-empty set."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        till, held = at, 0
        while till < len(sets) and (till == at or held + len(sets[till]) <= CHUNK):
            held += len(sets[till])
            till += 1
        values = np.concatenate(sets[at:till])
        cuts = np.cumsum([0] + [len(s) for s in sets[at : till - 1]])
        work = np.empty_like(values)
        for k in range(HASHES):
            np.multiply(values, FACTORS[k], out=work)
            work += TERMS[k]
            out[at:till, k] = np.minimum.reduceat(work, cuts) >> np.uint64(32)
        at = till
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, its number included."""
    parts = minima.reshape(len(minima), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX, (len(minima), 1))
    for k in range(BAND_ROWS):
        keys = (keys ^ parts[:, :, k]) * STEP
        keys ^= keys >> np.uint64(29)
    return (keys * MIX).view(np.int64)


def _signatures(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, size, hashes) for t in batch.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            minima = signature_rows(full) if full else np.zeros((0, HASHES), np.uint32)
            rows, keys = iter(minima[:, :CHECKED].astype(np.uint8)), iter(band_keys(minima))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signed = [next(rows).tobytes() if len(s) else None for s in sets]
            bands = [next(keys) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sig", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, size, hashes).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "shingles"])

    return run


def least_agreement(percent: int) -> int:
    """Signature agreements that a pair at the threshold misses with a probability of about 3e-6."""
    p = percent / 100
    return max(0, int(CHECKED * p - 4.5 * (CHECKED * p * (1 - p)) ** 0.5))


def _agreeing(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CHECKED) for i in (2, 3))
                yield batch.filter(pa.array((x == y).sum(axis=1) >= least)).select([0, 1])

    return run


def _confirmed(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    return run


def _near(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n_shingles, sig) of the given ids; where those are few, nodes is filtered in place instead of shuffled."""
    return materialize(nodes.select("id", "n_shingles", "sig").join(small(ids.persist()), "id", "left_semi"), "minhash-near")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures don't rule out."""
    near = _near(nodes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    side = lambda x: near.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"sig{x}"))
    signed = pairs.join(small(side("b"), SMALL_SIGNED), "b").join(small(side("a"), SMALL_SIGNED), "a")
    signed = signed.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "siga", "sigb")
    return signed.mapInArrow(_agreeing(least_agreement(percent)), "a long, b long")


def _set_rows(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the given documents alone."""
    return docs.join(small(ids), docs["doc_id"] == ids["id"], "left_semi").mapInArrow(_sets(size), "id long, shingles binary")


def _linked(likely: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    likely = materialize(likely, "minhash-likely")
    asked = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct().persist()
    if asked.isEmpty():
        return likely
    sets = _set_rows(asked, docs, size).persist()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set{x}"))
    full = likely.join(side("b"), "b").join(side("a"), "a").select("a", "b", "seta", "setb")
    links = materialize(full.mapInArrow(_confirmed(percent), "a long, b long").distinct(), "minhash-links")
    for old in (sets, asked):
        old.unpersist()
    discard(likely)
    return links


def _open_buckets(members: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """Members of the buckets with several components: bucket, id, n_shingles, component, and of the bucket group_size, major
    (its largest component), outside (how many members are not in it) and the shingles of both, all_words and out_words."""
    placed = members.join(small(found), "id", "left").select("bucket", "id", "n_shingles", F.coalesce("component", "id").alias("component")).persist()
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("words"))
    split = sizes.groupBy("bucket").agg(F.sum("n").alias("group_size"), F.sum("words").alias("all_words"), F.max(F.struct("n", "component", "words")).alias("top"))
    split = split.filter("group_size > top.n").select("bucket", "group_size", "all_words", F.col("top.component").alias("major"), (F.col("group_size") - F.col("top.n")).alias("outside"), (F.col("all_words") - F.col("top.words")).alias("out_words")).persist()
    out = materialize(lookup_join(placed, split, ["bucket"], total * BANDS), "minhash-open")
    for old in (split, placed):
        old.unpersist()
    return out


def _narrow(least: int, percent: int):
    """Members of narrow buckets against those outside the largest component: pairs of other components that sizes and
    signatures allow."""

    def met(ours: pa.ListArray, others: pa.ListArray) -> np.ndarray:
        one, two = ours.flatten(), others.flatten()
        mine, theirs = np.diff(ours.offsets.to_numpy()), np.diff(others.offsets.to_numpy())
        times = np.repeat(theirs, mine)  # others that each member meets
        first = np.repeat(np.cumsum(theirs) - theirs, mine)
        row = np.repeat(np.arange(len(one)), times)
        at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        (ids, component, sizes), (pid, pcomponent, psizes) = ([x.field(k).to_numpy(zero_copy_only=False) for k in range(3)] for x in (one, two))
        sizes, psizes = sizes[row], psizes[at]
        good = (component[row] != pcomponent[at]) & (100 * np.minimum(sizes, psizes) >= percent * np.maximum(sizes, psizes))
        row, at = row[good], at[good]
        x, y = (_bytes_of(z.field(3)) for z in (one, two))
        good = [(x[row[k : k + 4096]] == y[at[k : k + 4096]]).sum(axis=1) >= least for k in range(0, len(row), 4096)]
        good = np.concatenate(good) if good else np.zeros(0, bool)
        ids, pid = ids[row[good]], pid[at[good]]
        return np.stack([np.minimum(ids, pid), np.maximum(ids, pid)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ours, others = batch.column(0), batch.column(1)
            cost = np.cumsum(np.diff(ours.offsets.to_numpy()).astype(np.int64) * np.diff(others.offsets.to_numpy()))
            cuts = [*np.flatnonzero(np.diff(cost // MEETINGS, prepend=0)).tolist(), batch.num_rows]
            found, at = [np.zeros((2, 0), np.int64)], 0
            for till in cuts:
                if till > at:
                    found.append(met(ours.slice(at, till - at), others.slice(at, till - at)))
                    at = till
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _bytes_of(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, CHECKED)


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of some sets has in common with each of some others."""
    flat = [np.concatenate(x) for x in (one, two)]
    own = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(one), len(two)))
    if not len(common):
        return out
    at = [np.searchsorted(common, f) for f in flat]
    real = [common[np.minimum(a, len(common) - 1)] == f for a, f in zip(at, flat, strict=True)]
    own, at = [o[r] for o, r in zip(own, real, strict=True)], [a[r] for a, r in zip(at, real, strict=True)]
    for low in range(0, len(common), COLUMNS):
        sides = []
        for o, a, n in zip(own, at, out.shape, strict=True):
            here = (a >= low) & (a < low + COLUMNS)
            side = np.zeros((n, min(COLUMNS, len(common) - low)), np.float32)
            side[o[here], a[here] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest (row, column) of a matrix of links between two sides."""
    rows_left, columns_left, out = links.any(axis=1), np.ones(links.shape[1], bool), []
    while rows_left.any():
        rows = [int(np.argmax(rows_left))]
        rows_left[rows[0]] = False
        while rows:
            r = rows.pop()
            columns = np.flatnonzero(links[r] & columns_left).tolist()
            columns_left[columns] = False
            out += [(r, c) for c in columns]
            for c in columns:
                more = np.flatnonzero(links[:, c] & rows_left).tolist()
                rows_left[more] = False
                out += [(x, c) for x in more]
                rows += more
    return out


def _wide(least: int, percent: int):
    """Two cells of a wide bucket: a spanning forest of the links between them."""

    def run(cells: pa.Table) -> pa.Table:
        outside = cells.column("outsider").to_numpy()
        sides = []
        for mask in (~outside, outside):
            side = cells.filter(pa.array(mask))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in side.column("shingles").chunks for x in c]
            sides.append((side.column("id").to_numpy(), side.column("component").to_numpy(), sets, np.array([len(x) for x in sets], np.int64), signature_rows(sets)[:, :CHECKED].astype(np.uint8) if sets else np.zeros((0, CHECKED), np.uint8)))
        (ids, component, sets, sizes, x), (others, theirs, their_sets, their_sizes, y) = sides
        good = (component[:, None] != theirs) & (100 * np.minimum(sizes[:, None], their_sizes) >= percent * np.maximum(sizes[:, None], their_sizes))
        for r in np.flatnonzero(good.any(axis=1)).tolist():
            good[r] &= (x[r] == y).sum(axis=1) >= least
        rows, columns = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
        found = []
        if len(rows):
            both = shared_counts([sets[r] for r in rows], [their_sets[c] for c in columns])
            linked = 100 * both >= percent * (sizes[rows][:, None] + their_sizes[columns] - both)
            found = [(ids[rows[r]], others[columns[c]]) for r, c in forest(linked & good[np.ix_(rows, columns)])]
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return run


def _settled_narrow(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) of narrow open buckets."""
    near = _near(nodes, rows.select("id").distinct())
    member = F.struct("id", "component", "n_shingles", "sig")
    dealt = rows.drop("n_shingles").join(small(near, SMALL_SIGNED), "id").groupBy("bucket").agg(F.collect_list(member).alias("ours"), F.collect_list(F.when(F.col("component") != F.col("major"), member)).alias("others"))
    return dealt.select("ours", "others").mapInArrow(_narrow(least_agreement(percent), percent), "a long, b long").distinct()


def _settled_wide(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is linked in wide open buckets; each task gets two cells with their full sets."""
    asked = rows.select("id").distinct().persist()
    sets = _set_rows(asked, docs, size)
    cells_of = lambda n, words: F.ceil(F.greatest(F.col(n) / CELL, F.col(words) / CELL_SHINGLES)).cast("int")
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    dealt = rows.withColumns({"cells": cells_of("group_size", "all_words"), "other_cells": cells_of("outside", "out_words")}).select("bucket", "id", "component", "cells", "other_cells", (F.col("component") != F.col("major")).alias("out"))
    # a member is in one cell and meets each cell of outsiders; an outsider is in one cell of them besides and meets each cell
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meets = F.transform(every("other_cells"), lambda k: F.struct(F.lit(False).alias("outsider"), place("member", "cells").alias("cell"), k.alias("other_cell")))
    meets_out = F.transform(every("cells"), lambda k: F.struct(F.lit(True).alias("outsider"), k.alias("cell"), place("outsider", "other_cells").alias("other_cell")))
    dealt = dealt.select("bucket", "id", "component", F.explode(F.concat(meets, F.when(F.col("out"), meets_out).otherwise(F.slice(meets_out, 1, 0)))).alias("x")).select("bucket", "id", "component", "x.*")
    links = materialize(dealt.join(sets, "id").groupBy("bucket", "cell", "other_cell").applyInArrow(_wide(least_agreement(percent), percent), "a long, b long").distinct(), "minhash-wide")
    asked.unpersist()
    return links


def _star_pairs(rows: DataFrame, salt: int) -> DataFrame:
    """Pairs of each open bucket's outsiders with a drawn member of its largest component."""
    pivots = rows.filter("component = major").groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", F.lit(salt))).alias("pivot"))
    return rows.filter("component <> major").join(pivots, "bucket").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()


def _merged(found: DataFrame, *links: DataFrame) -> DataFrame:
    edges = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    for more in links:
        edges = edges.unionByName(more.select("a", "b"))
    return materialize(components(edges), "minhash-components")


def _same_ids(named: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) between a doc_id that stands at several sets and the classes of those."""
    several = named.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc_id").persist()
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    rows = named.select("doc_id", "digest").distinct().join(several, "doc_id", "left_semi")
    return materialize(spread_join(rows, classes.select("digest", "id", "group_size"), ["digest"], total).select(F.col("id").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct(), "minhash-same-ids")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept. docs needs doc_id and
    text."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = materialize(docs.mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"), "minhash-signed")
    named = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("group_size")), "minhash-classes")
    total = max(1, classes.count())
    dealt = classes.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    stats = materialize(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("pivot")).filter("group_size > 1"), "minhash-buckets")
    members = materialize(lookup_join(dealt, stats, ["bucket"], total * BANDS).select("bucket", "id", "n_shingles", "pivot"), "minhash-members")
    pairs = members.filter("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct().persist()
    links = _linked(_likely(pairs, classes, percent), docs, shingle, percent)
    pairs.unpersist()
    found = materialize(components(links.unionByName(_same_ids(named, classes, total))), "minhash-components")
    left, salt = math.inf, 0
    while True:
        rows = _open_buckets(members.select("bucket", "id", "n_shingles"), found, total)
        wide = F.col("group_size") > NARROW
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(wide, 1)).alias("wide"), F.sum(F.when(wide, F.col("outside").cast("double"))).alias("work")).first()
        if (seen.work or 0) <= WORK * total or seen.work > left / 2:
            break
        # another star does no harm to what buckets owe: what it links is one component less to compare
        left, salt = seen.work, salt + 1
        drawn = _star_pairs(rows, salt).persist()
        found = _merged(found, _linked(_likely(drawn, classes, percent), docs, shingle, percent))
        drawn.unpersist()
        discard(rows)
    new = [_linked(_settled_narrow(rows.filter(~wide), classes, percent), docs, shingle, percent)] if seen.n > seen.wide else []
    new += [_settled_wide(rows.filter(wide), docs, shingle, percent)] if seen.wide else []
    found = _merged(found, *new) if new else found
    for old in (stats, members, links, rows, *new):
        discard(old)
    final = classes.join(found, "id", "left").select("digest", "group_size", F.coalesce("component", "id").alias("component_id"))
    out = spread_join(named.select("doc_id", "n_shingles", "digest"), final, ["digest"], max(1, signed.count()))
    alone = signed.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup_near(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without all but the smallest doc_id of each group of near duplicates; all columns stay."""
    gone = near_duplicates(docs, shingle, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
