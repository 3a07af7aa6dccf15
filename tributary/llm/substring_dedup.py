"""Substring dedup by level-wise doubling.

A level has windows of twice the words of the one before (the last: of the length that counts), and
looks only at windows whose two halves repeat. The first looks at few windows: of any run of neighbours
that a window of the next level spans, the one with the least hash, so that equal windows look at equal
halves. At the last level repeats are told by 96 bits; with ``longest_repeats`` the doubling goes on
until no candidate survives.

What is repeated comes back to the documents as a bit map of bounded size: it only rules out, and never
loses a repeat. Where there is too much for a map, it comes back by joins, first by hash with the
windows that documents hold, then by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice, takewhile
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import integer_ids, stored, table
from .words import chunks, mix, owners, relax, windows, words_of

#: Words of a window that counts as a repeat.
LENGTH = 13
#: The bit map: bits per hash, and its bytes at most.
BITS_PER_HASH, MAX_MAP_BYTES = 24, 64 << 20
#: Bits of the map per hash, at least; with fewer it would rule out too little.
LEAST_BITS = 4
#: Candidate windows that a task settles among themselves before it sends what is left; occurrences of a
#: window among these from which the task remembers its least document, for so many windows.
SETTLED, HOT, REMEMBERED = 300_000, 16, 200_000
_LAST = np.int64((1 << 63) - 1)


def _ids(column: pa.Array) -> np.ndarray:
    """doc_ids as 64-bit integers; null comes after all others."""
    return column.cast(pa.int64()).fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)


class BitMap(NamedTuple):
    """Which leading bits hashes have; ``shift`` leaves so many of them."""

    shift: int
    bits: np.ndarray

    def __contains__(self, x):  # pragma: no cover - ``has`` is for arrays
        return bool(self.has(np.asarray([x], np.uint64))[0])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(self.shift)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def bit_map(hashes: DataFrame, n: int, max_bytes: int | None = None) -> BitMap:
    """A bit map of the one column of 64-bit hashes. Each task fills a segment of its own, and the
    driver holds the map alone: at most ``max_bytes``."""
    max_bytes = max_bytes or MAX_MAP_BYTES
    width = max(10, min((8 * max_bytes).bit_length() - 1, (max(n, 1) * BITS_PER_HASH - 1).bit_length()))
    segment = min(width - 3, 20)  # bits of a position within its segment
    name = hashes.columns[0]
    placed = hashes.select(F.shiftrightunsigned(F.col(name), 64 - width + segment).alias("s"), F.col(name).alias("h"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            s, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = (h.astype(np.int64).view(np.uint64) >> np.uint64(64 - width)) & np.uint64((1 << segment) - 1)
            for k in np.unique(s):
                m = maps.setdefault(int(k), np.zeros(1 << segment, bool))
                m[at[s == k]] = True
            relax()
        for k, m in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], ["s", "m"])

    bits = np.zeros(1 << (width - 3), np.uint8)
    for r in placed.repartition("s").mapInArrow(fill, "s bigint, m binary").toLocalIterator():
        part = np.frombuffer(r.m, np.uint8)
        bits[r.s * len(part) : (r.s + 1) * len(part)] |= part
    return BitMap(64 - width, bits)


def _least_of_runs(h: np.ndarray, fits: np.ndarray, run: int) -> np.ndarray:
    """Where a value is the least of some ``run`` neighbours that all fit."""
    n = len(h)
    chosen = np.zeros(n, bool)
    m = n - run + 1
    if m <= 0:
        return chosen
    low, whole = h[:m].copy(), fits[:m].copy()
    for j in range(1, run):
        np.minimum(low, h[j : j + m], out=low)
        whole &= fits[j : j + m]
    for j in range(run):
        chosen[j : j + m] |= whole & (h[j : j + m] == low)
    return chosen


def _runs_fit(words, length: int) -> np.ndarray:
    n = len(words.hash)
    return np.arange(n) + length <= np.repeat(words.first[1:], np.diff(words.first))


def _first_windows(docs: DataFrame, size: int, longer: int, by_id: bool = False, sampled: bool = True) -> DataFrame:
    """(h, n): windows of a batch of documents, those that the level of ``longer`` ones looks at, each
    once, and in how many (2: or more); or (h, id): each once for each document."""
    run = longer - size + 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = [], []
            for a, _, text in chunks(batch.column(1)):
                words = words_of(text)
                h, fits = windows(words, size)
                # a longer window's parts all lie within its document
                at = np.flatnonzero(_least_of_runs(h, fits, run) if sampled else fits)
                hashes.append(h[at])
                rows.append(owners(words.first)[at] + a)
            h, row = np.concatenate(hashes or [np.zeros(0, np.uint64)]), _ids(batch.column(0))[np.concatenate(rows or [np.zeros(0, np.int64)])]
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            other = np.zeros(len(h), bool)
            other[1:] = ~new[1:] & (row[1:] != row[:-1])
            if by_id:
                once = new | other
                yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), pa.array(row[once], pa.int64())], ["h", "id"])
                relax()
                continue
            first = np.flatnonzero(new)
            many = np.add.reduceat(other, first) if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(1 + (many > 0), pa.int32())], ["h", "n"])
            del hashes, rows, h, row, order, new, other, first, many
            relax()

    return docs.mapInArrow(sample, "h bigint, id bigint" if by_id else "h bigint, n int")


class Level(NamedTuple):
    """What a level found: words of its windows, hashes of those that repeat, and their number."""

    size: int
    repeated: DataFrame
    n: int


def level_sizes(length: int, start: int | None = None) -> list[int]:
    """Words of each level's windows: from ``start`` (or half the length), doubling, to ``length``."""
    sizes = [min(start or (length + 1) // 2, length)]
    while sizes[-1] < length:
        sizes.append(min(2 * sizes[-1], length))
    return sizes if len(sizes) > 1 else [length, length]


def levels(docs: DataFrame, sizes: Iterable[int], max_map_bytes: int | None = None) -> Iterator[Level]:
    """The levels of (doc_id, text) rows, one after the other. The first has samples only."""
    sizes = iter(sizes)
    size, longer, before = next(sizes), next(sizes), None
    while True:
        if before is None:
            found = _first_windows(docs, size, longer).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
        else:
            found = _repeats(docs, size, before, before_is_first, max_map_bytes, report=True)
        before_is_first = before is None
        found = stored(found)
        before = Level(size, found, found.count())
        yield before
        if longer is None:
            return
        size, longer = longer, next(sizes, None)


def _with_known(docs: DataFrame, size: int, before: Level, sampled: bool, max_map_bytes: int | None) -> tuple[DataFrame, BitMap | None]:
    """The documents, with what they have of the level before (``known``) unless a bit map tells."""
    if before.n * LEAST_BITS <= 8 * (max_map_bytes or MAX_MAP_BYTES):
        return docs.select("doc_id", "text"), bit_map(before.repeated, before.n, max_map_bytes)
    held = _first_windows(docs, before.size, size, by_id=True, sampled=sampled).join(before.repeated, "h", "left_semi")
    own = held.groupBy("id").agg(F.collect_set("h").alias("known"))
    id_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_LAST)))
    return docs.select("doc_id", "text", id_.alias("id")).join(own, "id").select("doc_id", "text", "known"), None


class _Own:
    """Which hashes each row of a batch knows."""

    def __init__(self, lists: pa.Array) -> None:
        size = np.diff(lists.offsets.to_numpy())
        rows = np.repeat(np.arange(len(size), dtype=np.uint64), size)
        self.keys = np.sort(mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ mix(rows)))

    def has(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), bool)
        key = mix(h ^ mix(row.astype(np.uint64)))
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key


class _Memory:
    """Windows that a task has met often, and the least document of each that it has sent."""

    def __init__(self) -> None:
        self.h1, self.h2, self.least = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def least_of(self, h1: np.ndarray, h2: np.ndarray, least: np.ndarray) -> np.ndarray:
        if not len(self.h1):
            return least
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        hit = (self.h1[at] == h1) & (self.h2[at] == h2)
        return np.where(hit, np.minimum(least, self.least[at]), least)

    def keep(self, h1: np.ndarray, h2: np.ndarray, least: np.ndarray) -> None:
        if len(self.h1) + len(h1) <= REMEMBERED:
            h1, h2, least = np.concatenate([self.h1, h1]), np.concatenate([self.h2, h2]), np.concatenate([self.least, least])
        order = np.lexsort((least, h2, h1))
        h1, h2, least = h1[order], h2[order], least[order]
        new = np.ones(len(h1), bool)
        new[1:] = h1[1:] != h1[:-1]
        self.h1, self.h2, self.least = h1[new], h2[new], least[new]


def _repeats(docs: DataFrame, length: int, before: Level, sampled: bool, max_map_bytes: int | None = None, report: bool = False) -> DataFrame:
    """Rows (id, packed): places and check values of a document's windows that start in a document
    with a smaller doc_id. Windows that a batch settles by itself aren't exchanged one by one.

    With ``report``, instead (h): the hashes of the windows that occur in two documents.
    """
    half = before.size
    run = length - half + 1
    docs, known = _with_known(docs, length, before, sampled, max_map_bytes)
    held = docs.sparkSession.sparkContext.broadcast(known)

    def settled(parts: list, memory: _Memory) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, pos = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pos, doc, h2, h1))
        h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        start = np.flatnonzero(new)
        low = doc[start] if report else memory.least_of(h1[start], h2[start], doc[start])
        later = doc > low[np.cumsum(new) - 1]
        if report:
            many = np.maximum.reduceat(later, np.flatnonzero(new))
            k = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(h1[k].view(np.int64)), pa.array(h2[k].view(np.int32)), pa.array(doc[k]), pa.array(1 + many.astype(np.int32), pa.int32()), pa.nulls(len(k), pa.binary())], ["h1", "h2", "id", "pos", "packed"])
            return
        often = np.diff(np.concatenate([start, [len(h1)]])) >= HOT
        memory.keep(h1[start[often]], h2[start[often]], low[often])
        k = np.flatnonzero(~later)
        yield pa.RecordBatch.from_arrays([pa.array(h1[k].view(np.int64)), pa.array(h2[k].view(np.int32)), pa.array(doc[k]), pa.array(pos[k], pa.int32()), pa.nulls(len(k), pa.binary())], ["h1", "h2", "id", "pos", "packed"])
        k = np.flatnonzero(later)
        if len(k):
            docs_, packed = _packed(doc[k], pos[k], h2[k])
            spread = pa.array(mix(docs_.view(np.uint64)).view(np.int64))
            n = len(docs_)
            yield pa.RecordBatch.from_arrays([spread, pa.array(np.zeros(n, np.int32)), pa.array(docs_), pa.array(np.zeros(n, np.int32)), packed], ["h1", "h2", "id", "pos", "packed"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, memory = held.value, _Memory()
        for batch in batches:
            ids, parts = _ids(batch.column(0)), []
            own = _Own(batch.column(2)) if filter_ is None else None
            seen = lambda h, row: own.has(h, row) if filter_ is None else filter_.has(h)  # noqa: B023, E731
            for a, _, text in chunks(batch.column(1)):
                words = words_of(text)
                h, fits = windows(words, half)
                full = _runs_fit(words, length)
                n, row = len(h), owners(words.first) + a
                if sampled:
                    low = h.copy()
                    m = max(0, n - run + 1)
                    for j in range(1, run):
                        np.minimum(low[:m], h[j : j + m], out=low[:m])
                    ok = np.zeros(n, bool)
                    # every half that shares the least hash of the window repeats
                    ok[:m] = seen(low[:m], row[:m]) & full[:m]
                else:
                    both = seen(h, row) & fits
                    ok, m = full.copy(), max(0, n - run + 1)
                    ok[:m] &= both[:m] & both[length - half : length - half + m]
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                h1, h2 = windows(words, length)[0][at], (windows(words, length, True)[0][at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                owner = owners(words.first)[at]
                parts.append((h1, h2, ids[owner + a], (at - words.first[owner]).astype(np.int64)))
                if sum(len(p[0]) for p in parts) > SETTLED:
                    yield from settled(parts, memory)
                    parts = []
            if parts:
                yield from settled(parts, memory)
            del parts
            relax()

    rows = docs.mapInArrow(emit, "h1 bigint, h2 int, id bigint, pos int, packed binary")
    if report:
        return rows.groupBy("h1", "h2").agg(F.sum("pos").alias("n"), F.count_distinct("id").alias("d")).where("n > 1 and (d > 1 or n > d)").select(F.col("h1").alias("h"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, []
        for batch in batches:
            local = np.asarray(batch.column(4).is_valid())
            if local.any():
                keep = batch.filter(pa.array(local))
                yield pa.RecordBatch.from_arrays([keep.column(2), keep.column(4)], ["id", "packed"])
                batch = batch.filter(pa.array(~local))
                if not batch.num_rows:
                    continue
            h1, h2, doc, pos = (batch.column(i).to_numpy() for i in range(4))
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last is None or (h1[0], h2[0]) != last[:2]
            starts = np.flatnonzero(new)
            least = np.concatenate([[last[2] if last else 0], doc[starts]])[np.cumsum(new)]
            last = (h1[-1], h2[-1], least[-1])
            k = np.flatnonzero(doc > least)
            if len(k):
                found.append((doc[k], pos[k].astype(np.int64), h2[k].view(np.uint32)))
            if sum(len(f[0]) for f in found) > 500_000:
                yield _flush(found)
            relax()
        if found:
            yield _flush(found)

    return rows.repartition("h1").sortWithinPartitions("h1", "h2", "id").mapInArrow(settle, "id bigint, packed binary")


def _packed(doc: np.ndarray, pos: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Per document: (place, check) pairs of 32 bits."""
    order = np.lexsort((pos, doc))
    doc, pairs = doc[order], np.stack([pos[order].astype(np.uint32), h2[order]], axis=1).astype("<u4")
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.concatenate([cut, [len(doc)]])
    return doc[cut], pa.array([pairs[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())


def _flush(found: list) -> pa.RecordBatch:
    doc, pos, h2 = (np.concatenate(x) for x in zip(*found))
    found.clear()
    docs, packed = _packed(doc, pos, h2)
    return pa.RecordBatch.from_arrays([pa.array(docs), packed], ["id", "packed"])


def repeated_windows(docs: DataFrame, length: int = LENGTH, max_map_bytes: int | None = None, start: int | None = None) -> DataFrame:
    """(id, packed): for each doc_id (an integer, else a TypeError; null: the greatest 64-bit one) its
    repeated windows. Levels begin at ``start`` words; from half the length, two are enough."""
    integer_ids(docs)
    texts, sizes = docs.select("doc_id", "text"), level_sizes(length, start)
    found = islice(levels(texts, sizes, max_map_bytes), len(sizes) - 1)
    *_, last = found
    return _repeats(texts, length, last, len(sizes) == 2, max_map_bytes).groupBy("id").agg(F.collect_list("packed").alias("packed"))


def longest_repeats(docs: DataFrame, length: int = LENGTH, max_map_bytes: int | None = None) -> list[tuple[int, int]]:
    """(words, distinct windows that two documents share) for ``length``, twice it, and so on, until
    none survives. A longer window is looked at only if both its halves repeat."""
    doubled = chain(level_sizes(length)[:-1], (length << k for k in count()))
    found = takewhile(lambda x: x.n, levels(docs.select("doc_id", "text"), doubled, max_map_bytes))
    return [(x.size, x.n) for x in islice(found, 1, None)]


def _kept(text: bytes, packed: list[bytes] | None, length: int) -> tuple[list[bytes], int]:
    """Words that stay, and how many there were."""
    words = text.split()
    if not packed or len(words) < length:
        return words, len(words)
    column = pa.array([text.decode()], pa.large_string())
    _, _, chunk = next(chunks(column))
    h2 = windows(words_of(chunk), length, True)[0]
    pairs = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2)
    pos, check = pairs[:, 0].astype(np.int64), pairs[:, 1]
    inside = pos + length <= len(words)
    pos, check = pos[inside], check[inside]
    # rows may share a doc_id: a place counts only where this text has that window
    pos = pos[(h2[pos] & np.uint64(0xFFFFFFFF)) == check]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + length, -1)
    stay = cover[:-1].cumsum() == 0
    return [w for w, s in zip(words, stay) if s], len(words)


def _with_repeats(docs: DataFrame, repeats: DataFrame) -> tuple[DataFrame, str, str]:
    names = {c.lower() for c in docs.columns}
    key, packed = "repeats_id", "repeats_packed"
    while key in names or packed in names:
        key, packed = key + "_", packed + "_"
    ids = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_LAST)))
    return docs.withColumn(key, ids).join(repeats.select(F.col("id").alias(key), F.col("packed").alias(packed)), key, "left"), key, packed


def digest_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row.

    A word goes if a window of ``length`` words covers it whose words also start in a document with a
    smaller doc_id. Null texts have no words; null doc_ids come after all others; rows that share a
    doc_id don't count as each other's repeats. Rows stay rows, an empty table gives an empty one.
    """
    joined, _, packed = _with_repeats(docs.select("doc_id", "text"), repeated_windows(docs, length))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for t, p in zip(batch.column(1), batch.column(2)):
                words, total = _kept((t.as_py() or "").encode(), p.as_py(), length)
                n.append(total)
                gone.append(total - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            relax()

    return joined.select("doc_id", "text", packed).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with all its columns; a text that loses words becomes its kept words joined by single
    spaces, and ``n_chars``, if there, its length. Other texts stay as they are."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, packed: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(texts, packed):
            words, total = _kept(t.encode(), list(p), length) if t and p is not None and len(p) else ((), 0)
            out.append(b" ".join(words).decode() if len(words) < total else t)
        relax()
        return pd.Series(out, dtype=object)

    joined, _, packed = _with_repeats(docs, repeated_windows(docs, length))
    fresh: Column = rest(F.col("text"), F.col(packed))
    out = joined.withColumn(packed, fresh)
    columns = [F.col(packed).alias("text") if c == "text" else F.when(F.col(packed).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(packed)).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
