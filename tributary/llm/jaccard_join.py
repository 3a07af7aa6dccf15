"""N-gram Jaccard join: exact, in the metric space of shingle sets.

Rows with equal sets are one class. Two kinds of pivots cut the space into regions:

1.  Single shingles. A set is nearest to the pivots it holds, all at the same distance, so ties go by
    a global order, and the window in which a similar set may lie is the first |x| - ceil(t |x|) + 3
    shingles of x: similar sets share three of these, and more the larger they are. A region of few
    sets proposes pairs of matching sizes; a pair that enough regions propose stays. A region of many is left open; its pivot goes to the end of the order, and only the sets
    that hold an open pivot enter the next round. Each pair is thus proposed, or both of its sets
    stay open.
2.  Sets. Each group that proposals and open pivots connect is a region to be joined
    exactly. It is cut into the Voronoi cells of some of its sets; a set goes to its own cell and, by
    the triangle inequality, to each that is nearer than its own plus twice the radius. Cells are cut
    again until few sets are left, which are compared. A large region is cut by all executors, a
    small one within a task. One that cells can't part, as a cluster of near copies, is joined by
    pairs of blocks, or at once in the task.

Shingles that rows of a sample share come last in the order from the first round on.

Distances of whole texts are too alike for pivots of the second kind alone: most are exactly 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .io import integer_ids, stored, table
from .substring_dedup import bit_map
from .words import chunks, mix, relax, windows, words_of

#: Hashes that are sent around as they are (8 bytes each); more go into a bit map of bounded size.
EXACT_HASHES = 1_000_000
#: Rows that are looked for by such a set of their ids; more are found by a join with these.
MAPPED_IDS = 100_000_000
#: Bits of a class's key; where two classes have one key, both get another.
CLASS_BITS = 64

#: One of so many rows tells which shingles are common.
SAMPLE = 32
#: Rows to look at again are kept apart where they are one of so many, at most.
FEW = 8

SHINGLE, PERCENT = 5, 80
#: Shingles that the windows of two similar sets share, at least.
SHARED = 3
#: Sets of a region that proposes pairs; rounds of reordering at most.
OPEN, ROUNDS = 64, 6
#: Sets, and shingles, of a region that one task joins; pivots of a larger one.
REGION_SETS, REGION_SHINGLES, PIVOTS = 4_000, 1_500_000, 24
#: Sets of a cell that are compared with each other.
CELL = 16
#: Sets are multiplied as rows of a matrix where it has at most so many cells for each that two sets
#: share; rows of the result, and cells of the matrix, at once.
DENSE, _ROWS, _CELLS = 16, 512, 4 << 20
_PAIRS = 400_000


def needed(n):
    """ceil(t n): what a set of n shingles shares with any similar one, at least."""
    return (PERCENT * n + 99) // 100


def window(n):
    """Shingles of a set's window."""
    return np.minimum(n, n - needed(n) + SHARED)


def shingles(text) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk of documents, sorted within each, and their bounds."""
    words = words_of(text, lower=True)
    h, fits = windows(words, SHINGLE)
    first = words.first
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    for d in np.flatnonzero((count > 0) & (count < SHINGLE)):
        a, b = first[d], first[d + 1]
        x = np.full(1, b - a, np.uint64)
        for w in words.hash[a:b]:
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) ^ w)
        h[a], fits[a] = x[0], True
    h, owner = h[fits], owner[fits]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(count) + 1))


def _fingerprints(h: np.ndarray, bounds: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: two sums of mixed hashes, with its size. Of the first, ``bits`` count."""
    out = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt) * (h | np.uint64(1)), dtype=np.uint64)])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return out[0] & np.uint64((1 << bits) - 1), out[1]


def _ragged(values: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The first ``sizes`` values between bounds, as lists."""
    take = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values[take].view(np.int64)))


def _behind(h: np.ndarray, bounds: np.ndarray, last: HashSet) -> np.ndarray:
    """The shingles of each set in the order of its window: those of ``last`` behind all others."""
    late = last.has(h)
    return h[np.argsort(2 * np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + late, kind="stable")] if late.any() else h


def _common(docs: DataFrame) -> DataFrame:
    """Shingles (tok) that some rows of a sample share. They go to the end of the order at once, where
    those of many sets would come after a round; the result is the same with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text in chunks(batch.column(1)):
                tok, k = np.unique(shingles(text)[0].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(k, pa.int64())], ["tok", "k"])
        relax()

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counted = sample.mapInArrow(run, "tok bigint, k bigint").groupBy("tok").agg(F.sum("k").alias("k"))
    return stored(counted.where((F.col("k") > 1) & (F.col("k") * SAMPLE >= OPEN)).select("tok"))


def _sets(docs: DataFrame, last: HashSet) -> DataFrame:
    """doc_id, n, f1, f2 and the window of each row's set, with the shingles of ``last`` behind all others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_ = held.value
        for batch in batches:
            for a, b, text in chunks(batch.column(1)):
                h, bounds = shingles(text)
                n = np.diff(bounds)
                f1, f2 = _fingerprints(h, bounds, CLASS_BITS)
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), _ragged(_behind(h, bounds, last_), bounds, window(n))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "win"])
        relax()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n int, f1 bigint, f2 bigint, win array<bigint>")


class HashSet:
    """Membership of 64-bit hashes, exact up to EXACT_HASHES and with false alarms beyond."""

    def __init__(self, hashes: DataFrame, n: int) -> None:
        self.map = self.sorted = None
        if n <= EXACT_HASHES:
            self.sorted = np.unique(hashes.toArrow().column(0).to_numpy().view(np.uint64))
            # most hashes aren't in, which their leading bits tell
            self.shift = np.uint64(64 - max(10, (16 * n).bit_length()))
            self.first = np.zeros(1 << (64 - int(self.shift)), bool)
            self.first[(self.sorted >> self.shift).astype(np.int64)] = True
        else:
            self.map = bit_map(hashes, n)

    def has(self, x: np.ndarray) -> np.ndarray:
        if self.map is not None:
            return self.map.has(x)
        if not len(self.sorted):
            return np.zeros(len(x), bool)
        out = self.first[(x >> self.shift).astype(np.int64)]
        some = x[out]
        out[out] = self.sorted[np.minimum(np.searchsorted(self.sorted, some), len(self.sorted) - 1)] == some
        return out


class _All:
    """A set of all hashes."""

    def has(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x), bool)


class Keys:
    """Keys of classes: 64 bits of the fingerprint, but for classes that have these in common."""

    def __init__(self, torn: dict[tuple[int, int], int]) -> None:
        self.torn, self.shared = torn, np.asarray(sorted({f1 for f1, _ in torn}), np.int64)

    def __call__(self, f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
        keys, f2 = f1.view(np.int64).copy(), f2.view(np.int64)
        if self.torn:
            for i in np.flatnonzero(np.isin(keys, self.shared)):
                keys[i] = self.torn.get((int(keys[i]), int(f2[i])), keys[i])
        return keys


def _rows_of(batch: pa.RecordBatch, wanted) -> pa.RecordBatch:
    """The rows whose doc_id may be wanted: known before any word is looked at."""
    return batch.filter(pa.array(wanted.has(_mixed(batch.column(0)))))


def _mixed(ids: pa.Array) -> np.ndarray:
    """doc_ids, spread over all 64-bit values: as they are, they would share their leading bits."""
    return mix(ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _windows_again(docs: DataFrame, wanted: HashSet, last: HashSet, keys: Keys) -> DataFrame:
    """cid, n and window of the wanted rows' sets, with the shingles of ``last`` behind all others."""
    held = docs.sparkSession.sparkContext.broadcast((wanted, last, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_, last_, keys_ = held.value
        for batch in batches:
            for _, _, text in chunks(_rows_of(batch, wanted_).column(1)):
                h, bounds = shingles(text)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([pa.array(keys_(*_fingerprints(h, bounds, CLASS_BITS))), pa.array(n, pa.int32()), _ragged(_behind(h, bounds, last_), bounds, window(n))], ["cid", "n", "win"])
        relax()

    return docs.mapInArrow(run, "cid bigint, n int, win array<bigint>")


def _only(docs: DataFrame, wanted: HashSet | _All) -> DataFrame:
    """The wanted rows, for more than one look at them."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows_of(batch, held.value)

    return stored(docs.mapInArrow(run, docs.schema))


def _whole_sets(docs: DataFrame, wanted: HashSet, keys: Keys) -> DataFrame:
    """cid and all shingles, as bytes, of the wanted rows' sets."""
    held = docs.sparkSession.sparkContext.broadcast((wanted, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_, keys_ = held.value
        for batch in batches:
            for _, _, text in chunks(_rows_of(batch, wanted_).column(1)):
                h, bounds = shingles(text)
                items = [h[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(keys_(*_fingerprints(h, bounds, CLASS_BITS))), pa.array(items, pa.binary())], ["cid", "item"])
        relax()

    return docs.mapInArrow(run, "cid bigint, item binary")


def _rows_with(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, HashSet | _All]:
    """Where the representatives of some classes are: rows, and the set of those to look at there."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(batch.column(0)).view(np.int64))], ["h"])

    ids = stored(classes.select(F.col("rep").cast("bigint").alias("rep")).distinct())
    n = ids.count()
    if n <= MAPPED_IDS:
        return docs, HashSet(ids.mapInArrow(spread, "h bigint"), n)
    found = docs.join(ids.where("rep is not null"), F.col("doc_id").cast("bigint") == F.col("rep"), "left_semi")
    return found if ids.where("rep is null").isEmpty() else found.union(docs.where("doc_id is null")), _All()


def least_shared(n, m):
    """Shingles that the windows of two similar sets of n and m shingles share, at least.

    Of the two windows, one ends first in the order. What the other set has up to there lies in its
    own window, so each shingle of the first window that isn't shared is missing from the other set
    for good; more than |x| - 4 (n + m) / 9 of them make the pair's overlap too small.
    """
    overlap = (4 * (n + m) + 8) // 9
    return np.maximum(1, np.minimum(overlap - n + window(n), overlap - m + window(m)))


def _pairs_of(tok: np.ndarray, cid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of rows of equal ``tok`` whose sizes are near enough, each once, with their number and
    the number that they need. Rows come by tok and n."""
    found, d, n = [], 1, n.astype(np.int64)
    while d < len(tok):
        same = tok[d:] == tok[:-d]
        if not same.any():
            break
        # smaller sets come first: the larger one's need must not exceed the smaller
        near = np.flatnonzero(same & (needed(n[d:]) <= n[:-d]))
        if len(near):
            found.append(np.stack([np.minimum(cid[near], cid[near + d]), np.maximum(cid[near], cid[near + d]), least_shared(n[near], n[near + d])]))
        d += 1
    if not found:
        return (np.zeros(0, np.int64),) * 4
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    return pairs[0, at], pairs[1, at], np.diff(np.concatenate([at, [pairs.shape[1]]])), pairs[2, at]


def _first_of(tok: np.ndarray, cid: np.ndarray) -> np.ndarray:
    once = np.ones(len(tok), bool)
    once[1:] = (tok[1:] != tok[:-1]) | (cid[1:] != cid[:-1])
    return once


def _regions(tokens: DataFrame) -> DataFrame:
    """From rows (cid, n, win): proposals (a, b, k, need), k a count of shared pivots, and open pivots
    (a = tok, b null). A task that meets a pivot many times sends one row for all others of its sets:
    it counts pivots in buckets, and those of full buckets one by one."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, sent = np.zeros(0, np.int64), np.zeros(1 << 17, np.int64)
        full, suspects, seen = np.zeros(1 << 20, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            # copies of a set that this task has sent lately
            place = (batch.column(0).to_numpy().view(np.uint64) & np.uint64(len(sent) - 1)).astype(np.int64)
            cid = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((sent[place] != cid) | (cid == 0)))
            sent[place] = cid
            lists, cid, n = batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            tok = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            cid, n = np.repeat(cid, sizes), np.repeat(n, sizes)
            keep = ~np.isin(tok, many)
            tok, cid, n = tok[keep], cid[keep], n[keep]
            order = np.lexsort((cid, tok))
            tok, cid, n = tok[order], cid[order], n[order]
            once = _first_of(tok, cid)  # of copies, one is enough
            tok, cid, n = tok[once], cid[once], n[once]
            start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([start, [len(tok)]]))
            bucket = (tok[start].view(np.uint64) & np.uint64(len(full) - 1)).astype(np.int64)
            np.add.at(full, bucket, size.astype(np.int32))
            watch = full[bucket] > OPEN
            suspects, at = np.unique(np.concatenate([suspects, tok[start][watch]]), return_inverse=True)
            seen = np.bincount(at, np.concatenate([seen, size[watch]]), len(suspects)).astype(np.int64)
            hot = seen > OPEN
            big = np.concatenate([suspects[hot], tok[start][size > OPEN]])
            if len(big):
                big = np.unique(big)
                many, suspects, seen = np.union1d(many, big), suspects[~hot], seen[~hot]
            if len(suspects) > len(full):  # of a very large task; forgotten pivots are counted anew
                often = seen > np.median(seen)
                suspects, seen = suspects[often], seen[often]
            if len(big):
                rest = ~np.isin(tok, big)
                yield pa.RecordBatch.from_arrays([pa.array(big), pa.nulls(len(big), pa.int64()), pa.array(np.zeros(len(big), np.int32))], ["tok", "cid", "n"])
                tok, cid, n = tok[rest], cid[rest], n[rest]
            yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(cid, pa.int64()), pa.array(n, pa.int32())], ["tok", "cid", "n"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        found: list[tuple] = []

        def settle(tok, cid, n, marked):
            """Whole groups: small ones to pairs, others to open pivots."""
            start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            size = np.diff(np.concatenate([start, [len(tok)]]))
            shut = np.add.reduceat(marked.astype(np.int64), start) > 0
            is_open = (size > OPEN) | shut
            rows = np.repeat((size > 1) & ~is_open, size)
            found.append(_pairs_of(tok[rows], cid[rows], n[rows]))
            return tok[start[is_open]]

        def batch_of(opened):
            a, b, k, need = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
            found.clear()
            m, none = len(opened), np.zeros(len(opened), np.int64)
            pair = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(m, pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, opened]), pa.int64()), pair, pa.array(np.concatenate([k, none]).astype(np.int32)), pa.array(np.concatenate([need, none]).astype(np.int32))], ["a", "b", "k", "need"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tok, marked = batch.column(0).to_numpy(), np.asarray(batch.column(1).is_null())
            cid, n = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            if held is not None:
                tok, cid, n, marked = (np.concatenate(x) for x in zip(held, (tok, cid, n, marked)))
            once = _first_of(tok, cid)
            tok, cid, n, marked = tok[once], cid[once], n[once], marked[once]
            last = int(np.searchsorted(tok, tok[-1], "left"))
            # the last group may go on; of a long one, OPEN + 1 rows tell enough
            keep = slice(last, min(len(tok), last + OPEN + 1))
            mark = marked[keep].copy()
            mark[0] |= marked[last:].any()
            held = (tok[keep], cid[keep], n[keep], mark)
            if last:
                opened = settle(tok[:last], cid[:last], n[:last], marked[:last])
                if len(opened) or sum(len(f[0]) for f in found) > _PAIRS:
                    yield batch_of(opened)
        if held is not None:
            yield batch_of(settle(*held))
        relax()

    thinned = tokens.select("cid", "n", "win").mapInArrow(thin, "tok bigint, cid bigint, n int")
    return thinned.repartition("tok").sortWithinPartitions("tok", "n", "cid").mapInArrow(propose, "a bigint, b bigint, k int, need int")


def _exact(members: list[tuple[int, bool, np.ndarray]], across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs among (cid, own, set): at least one of a pair is at home here; ``across``: exactly one."""
    k, none = len(members), np.zeros(0, np.int64)
    if k < 2:
        return none, none
    sizes = np.asarray([len(s) for *_, s in members])
    cids, own = np.asarray([m[0] for m in members], np.int64), np.asarray([m[1] for m in members], bool)
    tok = np.concatenate([s for *_, s in members])
    who = np.repeat(np.arange(k), sizes)
    # shingles of one set alone can't be shared
    order = np.argsort(tok, kind="stable")
    tok, who = tok[order], who[order]
    start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    df = np.diff(np.concatenate([start, [len(tok)]]))
    who, df = who[np.repeat(df > 1, df)], df[df > 1]
    found = []
    for i, j, shared in _overlaps(who, df, k):
        use = own[i] != own[j] if across else own[i] | own[j]
        i, j, shared = i[use], j[use], shared[use]
        hit = 100 * shared >= PERCENT * (sizes[i] + sizes[j] - shared)
        found.append(np.stack([cids[i[hit]], cids[j[hit]]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs.min(axis=0), pairs.max(axis=0)


def _overlaps(who: np.ndarray, df: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of k sets that share shingles, and how many. ``who`` has each shingle's sets, one
    shingle after the other, ``df`` their numbers. Sets that share most of theirs, as those of a
    cluster do, are multiplied as rows of a matrix."""
    at = np.concatenate([[0], np.cumsum(df)])
    if k < 64 or k * k * len(df) > DENSE * int((df.astype(np.int64) ** 2).sum()):
        code = np.repeat(np.arange(len(df)), df)
        back = np.argsort(who, kind="stable")
        by_set, bounds = code[back], np.searchsorted(who[back], np.arange(k + 1))
        for i in range(k):
            mine = by_set[bounds[i] : bounds[i + 1]]
            if not len(mine):
                continue
            n = df[mine]
            spans = np.repeat(at[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            shared = np.bincount(who[spans], minlength=k)
            shared[: i + 1] = 0
            j = np.flatnonzero(shared)
            if len(j):
                yield np.full(len(j), i), j, shared[j]
        return
    width = max(1, _CELLS // k)
    for a in range(0, k, _ROWS):
        shared = np.zeros((min(_ROWS, k - a), k - a), np.float32)
        for c in range(0, len(df), width):
            d = min(len(df), c + width)
            x = np.zeros((k, d - c), np.float32)
            x[who[at[c] : at[d]], np.repeat(np.arange(d - c), df[c:d])] = 1
            shared += x[a : a + _ROWS] @ x[a:].T
        i, j = np.nonzero(np.triu(shared, 1))
        yield i + a, j + a, shared[i, j].astype(np.int64)


def _apart(d: np.ndarray) -> list[int]:
    """Of pivots, by the distances among them, some that lie apart: several in a cluster would each
    get all of it."""
    kept: list[int] = []
    for q in range(len(d)):
        if (d[q, kept] > 2 * (1 - PERCENT / 100)).all():
            kept.append(q)
    return kept


def _cells(members: list[tuple[int, bool, np.ndarray]], cell: int) -> Iterator[list[tuple[int, bool, np.ndarray]]]:
    """The region of ``members`` as cells of at most ``cell`` sets, or of more where pivots part no further."""
    k = len(members)
    if k <= cell:
        yield members
        return
    items = [m[2] for m in members]
    tok, bounds = np.concatenate(items), np.cumsum([0, *map(len, items)])
    sizes, pivots = np.diff(bounds), np.unique(np.linspace(0, k - 1, min(PIVOTS, -(-2 * k // cell))).astype(int))
    d = np.ones((k, len(pivots)))
    for q, p in enumerate(pivots.tolist()):
        x = items[p]
        shared = np.concatenate([[0], np.cumsum(x[np.minimum(np.searchsorted(x, tok), len(x) - 1)] == tok)])[bounds]
        shared = np.diff(shared)
        d[:, q] = 1 - shared / (sizes + len(x) - shared)
    kept = _apart(d[pivots])
    pivots, d = pivots[kept], d[:, kept]
    radius, least, home = 1 - PERCENT / 100, d.min(axis=1), d.argmin(axis=1)
    near = (d <= least[:, None] + 2 * radius + 1e-9) & (d < 1)
    parts = [np.flatnonzero(near[:, q]) for q in range(len(pivots))] + [np.flatnonzero(least >= 1 - radius - 1e-9)]
    if max(map(len, parts)) > 0.8 * k or sum(map(len, parts)) > 3 * k:
        yield members
        return
    for q, part in enumerate(parts):
        far = q == len(pivots)
        yield from _cells([(members[i][0], members[i][1] and (far or int(home[i]) == q), items[i]) for i in part.tolist()], cell)


def _join_region(t: pa.Table) -> pa.Table:
    # rows of one set may come more than once
    members = {c: (c, o, np.frombuffer(s, np.uint64)) for c, o, s in zip(*(t.column(k).to_pylist() for k in ("cid", "own", "item")))}
    # two different blocks of a region: pairs within one of them meet elsewhere
    first, _, second = t.column("region")[0].as_py().rpartition("#")[2].partition(",") if t.num_rows else ("", "", "")
    across = bool(second) and first != second
    parts = [list(members.values())] if across else list(_cells(list(members.values()), CELL))
    pairs = np.concatenate([np.stack(_exact(part, across)) for part in parts], axis=1)
    if len(parts) > 1:  # cells overlap
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        new = np.ones(pairs.shape[1], bool)
        new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
        pairs = pairs[:, new]
    if t.num_rows > 200:
        relax()
    return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


def _distances(item: bytes, pivots: list[np.ndarray]) -> np.ndarray:
    x = np.frombuffer(item, np.uint64)
    out = np.ones(len(pivots))
    for i, p in enumerate(pivots):
        small, large = (x, p) if len(x) < len(p) else (p, x)
        if len(small):
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            shared = int((large[at] == small).sum())
            out[i] = 1 - shared / (len(x) + len(p) - shared)
    return out


def join_regions(members: DataFrame, region_sets: int = REGION_SETS, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Similar pairs (a, b) of classes that are in a region (region string, cid, own, item)."""
    radius, parents = 1 - PERCENT / 100, {}
    while True:
        members = stored(members)
        sizes = members.groupBy("region").agg(F.count("*").alias("sets"), F.sum(F.length("item") / 8).alias("total"))
        too_large = (F.col("sets") > region_sets) | ((F.col("total") > region_shingles) & (F.col("sets") > 2))
        large_rows = sizes.where(too_large & ~F.col("region").contains("#")).orderBy(F.desc("sets"), "region").limit(20).collect()
        if not large_rows:
            found = members.groupBy("region").applyInArrow(_join_region, "a bigint, b bigint")
            return found.distinct()
        is_large = F.col("region").isin([r.region for r in large_rows])
        rank = W.partitionBy("region").orderBy(F.xxhash64("cid"), "cid")
        chosen = members.where(is_large).select("region", "cid").withColumn("k", F.row_number().over(rank)).where(F.col("k") <= PIVOTS).select("region", "cid")
        pivots: dict[str, list[np.ndarray]] = {}
        for r in members.join(F.broadcast(chosen), ["region", "cid"]).select("region", "cid", "item").toLocalIterator():
            pivots.setdefault(r.region, []).append(np.frombuffer(r["item"], np.uint64))
        # cells that hardly shrank are joined by pairs of blocks, and so are regions that cells can't
        # part, as a cluster's: each cell would get nearly all of it. The others get pivots
        blocks = {}
        for r in large_rows:
            pivots[r.region], parted = _pivots_apart(pivots[r.region])
            if not parted or r.region in parents and r.sets > 0.8 * parents[r.region]:
                blocks[r.region] = max(2, -(-2 * r.sets // region_sets), int(-(-2 * r.total // region_shingles)))
        held = members.sparkSession.sparkContext.broadcast((pivots, blocks))

        def cut(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            pivots_, blocks_ = held.value
            for batch in batches:
                rows = []
                for region, cid, own, item in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if region in blocks_:
                        # every pair of blocks meets once; a block's own pairs meet in (i, i)
                        m = blocks_[region]
                        i = int(mix(np.asarray([cid]).view(np.uint64))[0] % np.uint64(m))
                        rows += [(f"{region}#{min(i, j)},{max(i, j)}", cid, i <= j, item) for j in range(m)]
                        if len(rows) > 256:
                            yield _members(rows)
                            rows = []
                        continue
                    d = _distances(item, pivots_[region])
                    home = int(d.argmin()) if d.min() < 1 else -1
                    for q in np.flatnonzero((d <= d.min() + 2 * radius + 1e-9) & (d < 1)):
                        rows.append((f"{region}/{q}", cid, own and int(q) == home, item))
                    if d.min() >= 1 - radius - 1e-9:
                        rows.append((f"{region}/-", cid, own, item))
                    if len(rows) > 256:
                        yield _members(rows)
                        rows = []
                if rows:
                    yield _members(rows)

        fresh = members.where(is_large).mapInArrow(cut, "region string, cid bigint, own boolean, item binary")
        for r in large_rows:
            for q in ("-", *range(PIVOTS)):
                parents[f"{r.region}/{q}"] = r.sets
        members = members.where(~is_large).unionByName(fresh)


def _pivots_apart(items: list[np.ndarray]) -> tuple[list[np.ndarray], bool]:
    """Of some sets of a region those that lie apart, and whether cells around these would part it, as
    far as the sets tell: none holds most of them, and they don't lie in many cells each."""
    d = np.stack([_distances(x.tobytes(), items) for x in items])
    kept = _apart(d)
    d, radius = d[:, kept], 1 - PERCENT / 100
    least = d.min(axis=1, keepdims=True)
    parts = np.concatenate([(d <= least + 2 * radius + 1e-9) & (d < 1), least >= 1 - radius - 1e-9], axis=1).sum(axis=0)
    return [items[q] for q in kept], bool(parts.max() <= 0.8 * len(items) and parts.sum() <= 3 * len(items))


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["region", "cid", "own", "item"])


def similar_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents with integer doc_ids (else a TypeError): rows' sets (doc_id, n, f1, f2), classes (cid, f1, f2, n, rep, mult), and the similar pairs of
    different classes (a, b), a below b. A class is told by 128 bits, and goes by 64 of its own."""
    integer_ids(docs)
    docs = docs.select("doc_id", "text")
    hot = _common(docs)
    sets = stored(_sets(docs, HashSet(hot, hot.count())))
    classes, keys = _classes(sets)
    left, n_left = docs, sets.count()
    cid = F.col("f1")
    if keys.torn:
        own = F.create_map(*[F.lit(x) for (f1, f2), k in keys.torn.items() for x in (f"{f1},{f2}", k)])
        cid = F.coalesce(own[F.concat_ws(",", "f1", "f2")], cid)
    now, still_open, pairs = sets.where("n > 0").select(cid.alias("cid"), "n", "win"), None, None
    for _ in range(ROUNDS):
        found = stored(_regions(now))
        # a pair whose shared pivots are all closed here is counted in full; others meet again
        enough = stored(found.where("b is not null").groupBy("a", "b").agg(F.sum("k").alias("k"), F.max("need").alias("need")).where("k >= need").select("a", "b"))
        pairs = enough if pairs is None else pairs.union(enough)
        fresh = found.where("b is null").select(F.col("a").alias("tok")).distinct()
        n_open = fresh.count()
        if not n_open:
            still_open = None
            break
        # the sets that hold an open pivot; others have met all that they can be similar to
        still_open = stored(_holding(now, HashSet(fresh, n_open)).distinct())
        if fresh.join(hot, "tok", "left_anti").isEmpty():
            break
        hot = stored(hot.union(fresh).distinct())
        rows, again = _rows_with(left, classes.join(still_open, "cid", "left_semi"))
        n_sets = still_open.count()
        if n_sets * FEW <= n_left:  # sets that aren't open now never will be
            rows, again = _only(rows, again), _All()
            left, n_left = rows, n_sets
        now = stored(_windows_again(rows, again, HashSet(hot, hot.count()), keys))
    else:
        fresh = None  # rounds are used up: what is left is connected by any pivot
    if still_open is not None:
        pairs = pairs.union(_stars(now.join(still_open, "cid", "left_semi"), _All() if fresh is None else HashSet(fresh, n_open)))
    groups = components(pairs).select(F.col("root").cast("string").alias("region"), F.col("node").alias("cid"))
    groups = stored(groups.join(classes.select("cid", "n", "rep"), "cid"))
    items = _whole_sets(*_rows_with(docs, groups), keys)
    size = groups.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    large = stored(size.where((F.col("sets") > REGION_SETS) | (F.col("total") > REGION_SHINGLES)).select("region"))
    member = lambda g: items.join(g.select("region", "cid"), "cid").select("region", "cid", F.lit(True).alias("own"), "item")
    links = member(groups.join(large, "region", "left_anti")).groupBy("region").applyInArrow(_join_region, "a bigint, b bigint")
    if not large.isEmpty():
        links = links.union(join_regions(member(groups.join(large, "region", "left_semi"))))
    return sets.select("doc_id", "n", "f1", "f2"), classes, stored(links)


def _classes(sets: DataFrame) -> tuple[DataFrame, Keys]:
    """Classes (cid, f1, f2, n, rep, mult). One exchange by 64 bits; it also tells which classes share
    these, of 10 billion some three pairs. Those are grouped by 128 bits, with new keys."""
    found = stored(sets.groupBy("f1").agg(F.min("f2").alias("f2"), F.max("f2").alias("other"), F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("mult")))
    whole = found.where("f2 = other").select(F.col("f1").alias("cid"), "f1", "f2", "n", "rep", "mult")
    torn = found.where("f2 <> other").select("f1")
    if torn.isEmpty():
        return whole, Keys({})
    apart = sets.join(F.broadcast(torn), "f1", "left_semi").groupBy("f1", "f2").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("mult"))
    apart = stored(apart.select(F.xxhash64("f1", "f2").alias("cid"), "f1", "f2", "n", "rep", "mult"))
    keys = Keys({(r.f1, r.f2): r.cid for r in apart.select("f1", "f2", "cid").collect()})
    return stored(whole.unionByName(apart)), keys


def _stars(now: DataFrame, opened: HashSet) -> DataFrame:
    """Edges (a, b) that connect all sets which hold the same open pivot: each with the first of its
    batch, and those with the first of all. So a pivot sends a row for a batch, however many hold it."""
    held = now.sparkSession.sparkContext.broadcast(opened)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, cid = batch.column(1), batch.column(0).to_numpy()
            offsets = lists.offsets.to_numpy()
            tok, cid = lists.values.to_numpy()[offsets[0] : offsets[-1]], np.repeat(cid, np.diff(offsets))
            use = held.value.has(tok.view(np.uint64))
            tok, cid = tok[use], cid[use]
            order = np.lexsort((cid, tok))
            tok, cid = tok[order], cid[order]
            first = np.ones(len(tok), bool)
            first[1:] = tok[1:] != tok[:-1]
            head = cid[np.flatnonzero(first)][np.cumsum(first) - 1] if len(tok) else cid
            pairs = np.unique(np.stack([head[~first], cid[~first]]), axis=1) if len(tok) else np.zeros((2, 0), np.int64)
            a, b = np.concatenate([cid[first], pairs[0]]), np.concatenate([cid[first], pairs[1]])
            t = pa.concat_arrays([pa.array(tok[first], pa.int64()), pa.nulls(pairs.shape[1], pa.int64())])
            yield pa.RecordBatch.from_arrays([t, pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["tok", "a", "b"])

    rows = stored(now.select("cid", "win").mapInArrow(run, "tok bigint, a bigint, b bigint"))
    heads = rows.where("tok is not null").select("tok", "a")
    least = heads.groupBy("tok").agg(F.min("a").alias("b"))
    return rows.where("tok is null").select("a", "b").union(heads.join(least, "tok").select("a", "b"))


def _holding(now: DataFrame, opened: HashSet) -> DataFrame:
    """cids of the rows whose window holds an open pivot."""
    held = now.sparkSession.sparkContext.broadcast(opened)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            has = held.value.has(lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64))
            total = np.concatenate([[0], np.cumsum(has)])
            offsets = offsets - offsets[0]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(total[offsets[1:]] > total[offsets[:-1]]))], ["cid"])

    return now.select("cid", "win").mapInArrow(run, "cid bigint")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id, f1 and f2 of each row.

    Null and empty texts have no shingles, no links and a component of their own. Rows with equal
    sets are linked, also where they share a doc_id or have none; ``component_id`` passes over null
    ids unless there are no others. Other columns aren't read; an empty table gives an empty result.
    """
    sets, classes, links = similar_classes(docs)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("cid").alias("b"), "mult"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("mult").alias("others"))
    roots = components(links).withColumnRenamed("node", "cid")
    ids = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = ids.where("root is not null").join(ids.where("cid = root or cid <> root").groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    info = least.join(linked, "cid", "left").select("f1", "f2", "mult", "component_id", (F.when(F.col("n") > 0, F.col("mult") - 1).otherwise(0) + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_similar"))
    total = sets.count()
    joined = join_hot(sets, info, ["f1", "f2"], "mult", total)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "n_similar", own.alias("component_id"), "f1", "f2")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], held: str, total: int, share: int = 10_000) -> DataFrame:
    """``left`` joined with ``right``, which has each key once and in ``held`` how many rows of
    ``left`` have it. Keys of more than ``total / share`` rows, fewer than ``share`` by that, are
    broadcast; only the others are shuffled."""
    bound = max(10_000, total // share)
    right = stored(right)
    hot = right.where(F.col(held) > bound)
    if hot.isEmpty():
        return left.join(right, keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(held) <= bound), keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of its least doc_id.

    Rows without words stay, each. Of rows that share the least doc_id and set, the least text stays.
    """
    kept = stored(similar_documents(docs))
    first = kept.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "f1", "f2")
    twice = kept.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    ids = first.select(F.col("doc_id").alias("kept_id")).distinct()
    if twice.isEmpty():
        gone = kept.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id"))
        if gone.count() <= EXACT_HASHES:  # no text is exchanged
            return docs.join(F.broadcast(gone), F.col("doc_id") == F.col("gone_id"), "left_anti")
        return docs.join(ids, F.col("doc_id") == F.col("kept_id"), "left_semi")

    @F.pandas_udf("f1 bigint, f2 bigint, n int")
    def prints(texts: pd.Series) -> pd.DataFrame:
        out = []
        for _, _, text in chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
            h, bounds = shingles(text)
            f1, f2 = _fingerprints(h, bounds, CLASS_BITS)
            out.append(pd.DataFrame({"f1": f1.view(np.int64), "f2": f2.view(np.int64), "n": np.diff(bounds)}))
        return pd.concat(out) if out else pd.DataFrame({"f1": [], "f2": [], "n": []})

    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), prints(F.col("text")).alias("p"))
    rows = rows.select("row", F.col("row.doc_id").alias("d"), "p.f1", "p.f2", "p.n")
    order = W.partitionBy("d", "f1", "f2").orderBy(F.col("row.text"))
    marked = rows.join(first.select(F.col("doc_id").alias("i"), F.col("f1").alias("g1"), F.col("f2").alias("g2")).distinct(), F.col("d").eqNullSafe(F.col("i")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left_semi")
    empty, full = marked.where("n = 0"), marked.where("n > 0")
    return empty.select("row.*").union(full.withColumn("k", F.row_number().over(order)).where("k = 1").select("row.*"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).drop("f1", "f2")


_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * k >= 80 * (n + m - k)),
r AS (WITH RECURSIVE r(x, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x AND r.c < l.y) SELECT x, min(c) AS c FROM r GROUP BY x)
SELECT s.doc_id AS doc_id, CAST(len(g) AS BIGINT) AS n_shingles, (SELECT count(*) FROM l WHERE l.x = s.doc_id) AS n_similar, r.c AS component_id
FROM s JOIN r ON r.x = s.doc_id"""

QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLE_SQL = {"op7_jaccard_join": _SQL}
