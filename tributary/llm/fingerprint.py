"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk where its low bits are all ones; each chunk's hash gives
one sign of the signature. Block sizes are powers of two, so the chunk ends of a doubled block size
are among those of the smaller one. A fingerprint is ``size:signature:signature at twice the size``;
two are compared at a size they share, by the edit distance of insertions and deletions.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import integer_ids, stored, table
from .words import _BYTE, _BYTE2, _byte_powers, mix

WINDOW, SIGNS, LEAST_BLOCK = 7, 64, 4
#: Signatures must share a run of so many signs to be alike at all.
COMMON = 3
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


class Prints:
    """Signatures of some texts: ``level``, and for both sizes signs (0-63, 255 beyond the end) and lengths."""

    def __init__(self, level: np.ndarray, signs: list[np.ndarray], length: list[np.ndarray]) -> None:
        self.level, self.signs, self.length = level, signs, length

    def strings(self) -> list[str]:
        text = [[_ALPHABET[row[:n]].tobytes().decode() for row, n in zip(s, m)] for s, m in zip(self.signs, self.length)]
        return [f"{LEAST_BLOCK << int(k)}:{a}:{b}" for k, a, b in zip(self.level, *text)]

    def take(self, rows) -> Prints:
        return Prints(self.level[rows], [s[rows] for s in self.signs], [n[rows] for n in self.length])


def prints(texts: list[bytes]) -> Prints:
    """Signatures of UTF-8 texts, all at once."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    up, down = _byte_powers(len(data) + 1)
    sums, chunk_sums = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    np.cumsum(_BYTE2[data] * up[:-1], out=chunk_sums[1:])
    # the last WINDOW bytes, fewer at a text's start
    begin = np.arange(len(data)) - (WINDOW - 1)
    np.maximum(begin, 0, out=begin)
    for j in range(WINDOW - 1):
        at = offsets[:-1][sizes > j] + j
        begin[at] = at - j
    rolled = mix((sums[1:] - sums[begin]) * down[begin])
    # how many low bits of the rolling hash are ones: at level k a chunk ends where there are 2 + k or more
    ones = rolled & ~(rolled + np.uint64(1))
    possible = np.flatnonzero(ones >= np.uint64(LEAST_BLOCK - 1))
    bits = np.bitwise_count(ones[possible]).astype(np.int64) - 2
    owner = np.searchsorted(offsets, possible, "right") - 1
    # ends at or above each level, by document; the level is the highest with enough chunks
    top = int(bits.max(initial=0)) + 1
    counts = np.zeros((n, top + 1), np.int64)
    np.add.at(counts, (owner, np.minimum(bits, top)), 1)
    counts = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    level = np.maximum((counts + 1 >= SIGNS // 2).sum(axis=1) - 1, 0)
    signs, lengths = [], []
    for up_by in (0, 1):
        use = bits >= level[owner] + up_by
        ends, docs = possible[use] + 1, owner[use]
        # every text's end closes its last chunk
        tail = sizes > 0
        ends, docs = np.concatenate([ends, offsets[1:][tail]]), np.concatenate([docs, np.flatnonzero(tail)])
        order = np.lexsort((ends, docs))
        ends, docs = ends[order], docs[order]
        new = np.ones(len(ends), bool)
        new[1:] = (ends[1:] != ends[:-1]) | (docs[1:] != docs[:-1])
        ends, docs = ends[new], docs[new]
        first = np.searchsorted(docs, np.arange(n + 1))
        rank = np.arange(len(docs)) - first[docs]
        total = np.diff(first)
        # chunks beyond the last sign join it
        keep = (rank < SIGNS - 1) | (rank == total[docs] - 1)
        ends, docs = ends[keep], docs[keep]
        rank = np.minimum(rank[keep], SIGNS - 1)
        starts = np.where(rank == 0, offsets[docs], np.concatenate([[0], ends[:-1]])) if len(ends) else ends
        value = mix((chunk_sums[ends] - chunk_sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) >> np.uint64(58)
        grid = np.full((n, SIGNS), 255, np.uint8)
        grid[docs, rank] = value.astype(np.uint8)
        signs.append(grid)
        lengths.append(np.minimum(total, SIGNS))
    return Prints(level, signs, lengths)


def _alike(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 - distance / lengths for rows of signatures, by a bit-parallel longest common subsequence."""
    rows = len(a)
    if not rows:
        return np.zeros(0)
    masks = np.zeros((rows, 256), np.uint64)
    at = np.arange(rows)
    for i in range(SIGNS):
        masks[at, a[:, i]] |= np.uint64(1) << np.uint64(i)
    masks[:, 255] = 0
    state = np.full(rows, ~np.uint64(0))
    for j in range(int(n.max(initial=0))):
        hit = state & masks[at, b[:, j]]
        state = (state + hit) | (state - hit)
    inside = np.where(m >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(m, 63).astype(np.uint64)) - np.uint64(1))
    common = np.bitwise_count(~state & inside).astype(float)
    score = 2 * common / np.maximum(m + n, 1)
    # chance subsequences don't count: a common run must be there, or all of the shorter one
    run = np.minimum(COMMON, np.minimum(m, n))
    for length in range(1, COMMON + 1):
        rows_ = np.flatnonzero(run == length)
        if len(rows_):
            keys = []
            for s, k in ((a[rows_], m[rows_]), (b[rows_], n[rows_])):
                gram = sum(s[:, i : SIGNS - length + 1 + i].astype(np.int64) << (8 * i) for i in range(length))
                r, c = np.nonzero(np.arange(gram.shape[1]) + length <= k[:, None])
                keys.append(r.astype(np.int64) << 32 | gram[r, c])
            shared = np.zeros(len(rows_), bool)
            shared[keys[1][np.isin(keys[1], keys[0])] >> 32] = True
            score[rows_[~shared]] = 0
    score[run == 0] = 0
    return score


def likeness(x: Prints, y: Prints) -> np.ndarray:
    """Row by row, 0 to 1: 1 for equal fingerprints, 0 for sizes that aren't compatible."""
    score = np.zeros(len(x.level))
    for i in (0, 1):
        for j in (0, 1):
            rows = np.flatnonzero(x.level + i == y.level + j)
            if len(rows):
                found = _alike(x.signs[i][rows], x.length[i][rows], y.signs[j][rows], y.length[j][rows])
                score[rows] = np.maximum(score[rows], found)
    same = (x.level == y.level) & (x.signs[0] == y.signs[0]).all(axis=1) & (x.signs[1] == y.signs[1]).all(axis=1)
    score[same] = 1.0
    return score


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the start of the next text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k] if k else text


_FIELDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(texts: list[str]) -> list[pa.Array]:
    """Columns of _FIELDS for all but the last of some texts that follow each other."""
    n = len(texts) - 1
    raw = [edited(t, f).encode() for t, f in zip(texts, texts[1:])]
    p = prints([t.encode() for t in texts] + raw)
    own, nxt, other = p.take(slice(0, n)), p.take(slice(1, n + 1)), p.take(slice(n + 1, None))
    return [
        pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), pa.array(own.strings(), pa.string()), pa.array(other.strings(), pa.string()),
        pa.array(likeness(own, other), pa.float64()), pa.array(likeness(own, nxt), pa.float64()),
    ]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each whole text; null is as empty (``4::``). Needs no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                texts = [(t or "").encode() for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints(texts).strings(), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _runs(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    ends = np.cumsum([0, *(len(t) if t else 0 for t in column.to_pylist())])
    a = 0
    while a < len(column):
        b = min(len(column), max(a + 1, int(np.searchsorted(ends, ends[a] + size, "right")) - 1))
        yield a, b
        a = b


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id and _FIELDS of each document against its edit and the next one by descending doc_id (an
    integer, else a TypeError).

    Null doc_ids come last, rows that share a doc_id are ordered by text (null first), and the first
    follows the last; a single row follows itself. Null texts are as empty: two empty fingerprints
    are equal, so their likeness is 1. One shuffle, by ranges of doc_id; only the first and the last
    text of each range are carried over its border.
    """
    integer_ids(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f.split(" ")[0] for f in _FIELDS.split(", ")]

    def rows(role: int, part: str, ids: list, columns: list[pa.Array] | None, texts: list | None) -> pa.RecordBatch:
        n = len(ids)
        blank = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([role] * n, pa.int32()), pa.array([part] * n, pa.string()), pa.array(ids, pa.int64()), *(columns or blank), pa.array(texts or [None] * n, pa.string())], ["role", "part", "doc_id", *names, "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = uuid.uuid4().hex, None
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                ids, texts = batch.column(0).slice(a, b - a).to_pylist(), [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                if held is None:
                    yield rows(1, part, ids[:1], None, texts[:1])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1])
                if len(ids) > 1:
                    yield rows(0, part, ids[:-1], _judge(texts), None)
        if held is not None:
            yield rows(2, part, [held[0]], None, [held[1]])

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    done = stored(ordered.mapInArrow(run, f"role int, part string, doc_id bigint, {_FIELDS}, text string"))
    # the order of the ranges: one row each
    heads = done.where("role = 1").select("part", "doc_id").collect()
    heads.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    spark = docs.sparkSession
    follows = spark.createDataFrame([(r.part, heads[(i + 1) % len(heads)].part) for i, r in enumerate(heads)], "part string, next string")
    ends = done.where("role = 2").select("part", "doc_id", "text").join(follows, "part").join(done.where("role = 1").select(F.col("part").alias("next"), F.col("text").alias("following")), "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
            for i in range(len(ids)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1], pa.int64()), *_judge([texts[i], following[i]])], ["doc_id", *names])

    closed = ends.select("doc_id", "text", "following").mapInArrow(close, f"doc_id bigint, {_FIELDS}")
    return done.where("role = 0").select("doc_id", *names).unionByName(closed).withColumn("doc_id", F.col("doc_id").cast(kind))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprint": op8_fingerprint}
ORACLE_SQL: dict[str, str] = {}
