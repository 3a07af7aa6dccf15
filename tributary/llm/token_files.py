"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

A part holds the ids of consecutive documents as one stream, cut into blocks. A block stores its
minimum, a width that most differences to it fit in (chosen at a percentile), the differences packed
at that width, and a list of the others. Starts of blocks and ends of documents follow the blocks, so
that any document is read without those before it.

Layout: blocks | block starts (u64) | doc ids (i64) | their validity (u8) | document ends (u64) | tail
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import integer_ids, scratch_uri, table
from .words import _BYTE, _BYTE2, LOWER, Text, _byte_powers, chunks, mix, relax

BLOCK, PERCENTILE = 1024, 0.98
_HEAD = struct.Struct("<IBHH")  # minimum, width, exceptions, ids
_TAIL = struct.Struct("<QQQIf8s")  # blocks, documents, ids, block size, percentile, magic
_MAGIC = b"TRIBPFR1"
#: Ids coded at once.
_STRIDE = 64
#: Pieces that the library gets at once: it holds some hundred bytes for each.
_WORDS = 16_384


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of integers below 2**width -> rows of bytes, least significant bits first."""
    n, m = rows.shape
    as_bits = np.unpackbits(np.ascontiguousarray(rows, "<u4").view(np.uint8).reshape(n, m, 4), axis=2, bitorder="little")
    return np.packbits(as_bits[:, :, :width].reshape(n, m * width), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, width: int, m: int) -> np.ndarray:
    n = len(rows)
    if not width:
        return np.zeros((n, m), np.uint32)
    as_bits = np.zeros((n, m, 32), np.uint8)
    as_bits[:, :, :width] = np.unpackbits(rows, axis=1, count=m * width, bitorder="little").reshape(n, m, width)
    return np.packbits(as_bits.reshape(n, m * 32), axis=1, bitorder="little").view("<u4")


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of the rows of a matrix of ids."""
    n, m = ids.shape
    least = ids.min(axis=1)
    off = ids - least[:, None]
    k = min(m - 1, int(np.ceil(percentile * m)) - 1)
    at = np.partition(off, k, axis=1)[:, k]
    widths = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(int)
    out: list[bytes] = [b""] * n
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        part = off[rows]
        over = part >= (1 << int(w))
        packed = _pack(np.where(over, 0, part), int(w)) if w else np.zeros((len(rows), 0), np.uint8)
        for i, r in enumerate(rows):
            x = np.flatnonzero(over[i])
            out[r] = _HEAD.pack(int(least[r]), int(w), len(x), m) + packed[i].tobytes() + x.astype("<u2").tobytes() + part[i, x].astype("<u4").tobytes()
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of some blocks, in order."""
    heads = [_HEAD.unpack_from(b) for b in blocks]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, w, _, m) in enumerate(heads):
        groups.setdefault((w, m), []).append(i)
    for (w, m), members in groups.items():
        size = (m * w + 7) // 8
        packed = np.frombuffer(b"".join(blocks[i][_HEAD.size : _HEAD.size + size] for i in members), np.uint8).reshape(len(members), size)
        rows = _unpack(packed, w, m)
        for row, i in zip(rows, members):
            least, _, n, _ = heads[i]
            if n:
                a = _HEAD.size + size
                row[np.frombuffer(blocks[i], "<u2", n, a)] = np.frombuffer(blocks[i], "<u4", n, a + 2 * n)
            out[i] = row + np.uint32(least)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Writer:
    """Streams documents into one part; holds no more than some blocks and the document index."""

    def __init__(self, file, block: int = BLOCK, percentile: float = PERCENTILE) -> None:
        self.file, self.block, self.percentile = file, block, percentile
        self.at, self.total, self.held, self.waiting = 0, 0, 0, []
        self.starts, self.docs, self.ends = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.total += len(ids)
        self.ends.append(self.total)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block * _STRIDE:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting).astype(np.uint32) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) // self.block * self.block
        for a in range(0, whole, self.block * _STRIDE):
            self._write(ids[a : min(whole, a + self.block * _STRIDE)].reshape(-1, self.block))
        rest = ids[whole:]
        if last and len(rest):
            self._write(rest.reshape(1, -1))
            rest = rest[:0]
        self.waiting, self.held = [rest], len(rest)

    def _write(self, rows: np.ndarray) -> None:
        for b in encode_blocks(rows, self.percentile):
            self.starts.append(self.at)
            self.file.write(b)
            self.at += len(b)

    def close(self) -> None:
        self._flush(True)
        self.file.write(np.asarray([*self.starts, self.at], "<u8").tobytes())
        self.file.write(np.asarray([d or 0 for d in self.docs], "<i8").tobytes())
        self.file.write(np.asarray([d is not None for d in self.docs], np.uint8).tobytes())
        self.file.write(np.asarray(self.ends, "<u8").tobytes())
        self.file.write(_TAIL.pack(len(self.starts), len(self.docs), self.total, self.block, self.percentile, _MAGIC))
        self.file.close()


class Reader:
    """Random access to the documents of one part."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        blocks, n, self.total, self.block, _, magic = _TAIL.unpack(self._bytes(size - _TAIL.size, size))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        a = size - _TAIL.size - (blocks + 1) * 8 - n * 17
        index = self._bytes(a, size - _TAIL.size)
        self.starts = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        ids, valid = np.frombuffer(index, "<i8", n, (blocks + 1) * 8), np.frombuffer(index, np.uint8, n, (blocks + 1) * 8 + n * 8)
        self.docs = [int(d) if v else None for d, v in zip(ids, valid)]
        self.bounds = np.concatenate([[0], np.frombuffer(index, "<u8", n, (blocks + 1) * 8 + n * 9).astype(np.int64)])

    def _bytes(self, a: int, b: int) -> bytes:
        self.file.seek(a)
        return self.file.read(b - a)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the part's stream: only their blocks are read."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        raw, base = self._bytes(int(self.starts[first]), int(self.starts[last + 1])), int(self.starts[first])
        cut = self.starts[first : last + 2] - base
        return decode_blocks([raw[x:y] for x, y in zip(cut, cut[1:])])[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.bounds[k]), int(self.bounds[k + 1]))

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, some blocks at a time."""
        k, n = 0, len(self.docs)
        while k < n:
            # documents that end within the next blocks, or one longer than these
            e = max(k + 1, int(np.searchsorted(self.bounds, self.bounds[k] + self.block * _STRIDE, "right")) - 1)
            a = int(self.bounds[k])
            ids = self.ids(a, int(self.bounds[e]))
            for i in range(k, e):
                yield self.docs[i], ids[int(self.bounds[i]) - a : int(self.bounds[i + 1]) - a]
            k = e


#: Kinds of bytes: white space, letters, signs that neither open nor join anything, and all others.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = 2


class Pieces(NamedTuple):
    """Pieces of a chunk of texts: two hashes, byte bounds, whether the library must see them as they
    are, the bounds of each text in them, and the bytes, lower-cased but for those."""

    h1: np.ndarray
    h2: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    whole: np.ndarray
    first: np.ndarray
    data: np.ndarray


def pieces_of(text: Text) -> Pieces:
    """Runs of letters and of signs; between white space where anything else is, the whole of it.

    The vocabulary's splitter parts letters from signs and drops white space, and its normaliser only
    lower-cases the letters of ASCII and Latin-1, so a text's ids are those of its pieces in turn.
    """
    data, kind = text.data, _KIND[text.data]
    low = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) > 1 else np.zeros(0, np.int64)
    second = data[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    kind[lead[letter]] = kind[lead[letter] + 1] = 1
    low[lead[letter & (second < 0x9F)] + 1] += 0x20
    inner = text.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]

    def runs(same: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of runs of equal values that are used and lie in one text."""
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = same[1:] != same[:-1]
        cut[inner] = True
        return np.flatnonzero(cut[:-1] & used), np.flatnonzero(cut[1:] & used) + 1

    filled = kind > 0
    starts, ends = runs(filled, filled)
    odd = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind == 3, out=odd[1:])
    mixed = odd[ends] > odd[starts]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[mixed]] += 1
    edge[ends[mixed]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    kind[inside] = 3
    low[inside] = data[inside]
    starts, ends = runs(kind, filled)
    up, down = _byte_powers(len(data) + 1)
    hashes = []
    for table_ in (_BYTE, _BYTE2):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table_[low] * up[:-1], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return Pieces(*hashes, starts, ends, kind[starts] == 3, np.searchsorted(starts, text.offsets), low)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, a place of each, and the number of each place's value. No stable sort is needed."""
    order = np.argsort(x)
    value = x[order]
    new = np.ones(len(x), bool)
    new[1:] = value[1:] != value[:-1]
    back = np.empty(len(x), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return value[new], order[new], back


class Known:
    """Ids of pieces by hash, in a few arrays: a dict's objects would take three times the memory."""

    def __init__(self) -> None:
        self.keys, self.marks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, which are in order, and whether they are here."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Second hashes, counts and ids of the pieces at some places."""
        return self.marks[at], self.counts[at], _gather(self.ids, self.starts[at], self.counts[at])

    def add(self, keys: np.ndarray, marks: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Pieces that aren't here yet, in the order of their hashes."""
        at = np.searchsorted(self.keys, keys)
        starts = len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts
        self.ids = np.concatenate([self.ids, ids])
        for name, x in (("keys", keys), ("marks", marks), ("starts", starts), ("counts", counts)):
            setattr(self, name, np.insert(getattr(self, name), at, x))


def _gather(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ids, one after the other."""
    kind = np.int32 if max(len(ids), int(counts.sum(dtype=np.int64))) < 1 << 31 else np.int64
    place = np.repeat((starts - np.cumsum(counts, dtype=np.int64) + counts).astype(kind), counts)
    place += np.arange(len(place), dtype=kind)
    return ids[place]


class UnitEncoder:
    """The library's ids of whole texts, by pieces that it treats apart.

    Pieces are told from each other by two 64-bit hashes, over all of a slice at once; each different
    one is looked up once. Those met before, up to two generations of ``size``, aren't encoded again;
    of new ones, plain words go to the library ``_WORDS`` in a call, others in a batch.
    """

    def __init__(self, path: str, size: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        # for pieces that are normalised and split already, and hold no added token; both share one model
        self.words = Tokenizer(self.library.model)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.size, self.known, self.old = size, Known(), Known()

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one after the other, and the bounds of each."""
        parts: list[Pieces] = []
        docs, held, none = [], 0, np.zeros(0, np.uint64)
        hashes: tuple[list[np.ndarray], list[np.ndarray]] = ([none], [none])
        for _, _, text in chunks(column):
            p = pieces_of(text)
            hashes[0].append(p.h1), hashes[1].append(p.h2)
            # a text has below 2**31 bytes
            parts.append(p._replace(h1=none, h2=none, starts=p.starts.astype(np.int32), ends=p.ends.astype(np.int32)))
            docs.append(p.first[1:] + held)
            held += len(p.h1)
        if not held:
            return np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
        h1, h2 = map(np.concatenate, hashes)
        del p, hashes
        keys, at, back = _distinct(h1)
        if (h2[at][back] != h2).any():  # two pieces of one hash: tell them by both
            keys, at, back = _distinct(h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15)))
        marks = h2[at]
        del h1, h2
        missing = np.flatnonzero(~self.known.find(keys)[1])
        place, there = self.old.find(keys[missing])
        self.known.add(keys[missing[there]], *self.old.rows(place[there]))
        new = missing[~there]
        if len(new):
            self.known.add(keys[new], marks[new], *self._encode(parts, at[new]))
        del parts
        known = self.known
        place, _ = known.find(keys)
        if (known.marks[place] != marks).any():
            self.known, self.old = Known(), Known()  # another piece has this hash: forget all, and go again
            return self(column)
        count = known.counts[place][back]
        ids = _gather(known.ids, known.starts[place][back], count)
        if len(known.keys) > self.size:
            self.known, self.old = Known(), known
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return ids, total[np.concatenate([[0], *docs])]

    def _encode(self, parts: list[Pieces], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids of the pieces with these numbers, and their ids one after the other."""
        bounds = np.cumsum([0, *(len(p.starts) for p in parts)])
        texts: list[str] = [""] * len(at)
        whole = np.zeros(len(at), bool)
        for g, p in enumerate(parts):
            here = np.flatnonzero((at >= bounds[g]) & (at < bounds[g + 1]))
            if len(here):
                j, raw = at[here] - bounds[g], p.data.tobytes()
                whole[here] = p.whole[j]
                for i, x, y in zip(here.tolist(), p.starts[j].tolist(), p.ends[j].tolist()):
                    texts[i] = raw[x:y].decode()
        counts, flat = np.zeros(len(at), np.int32), []
        plain, others = np.flatnonzero(~whole), np.flatnonzero(whole)
        for a in range(0, len(plain), _WORDS):
            some = plain[a : a + _WORDS]
            e = self.words.encode([texts[i] for i in some.tolist()], is_pretokenized=True, add_special_tokens=False)
            counts[some] = np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(some))
            flat.append(np.asarray(e.ids, "<u4"))
        for a in range(0, len(others), _WORDS):
            some = others[a : a + _WORDS]
            found = [np.asarray(e.ids, "<u4") for e in self.library.encode_batch_fast([texts[i] for i in some.tolist()], add_special_tokens=False)]
            counts[some] = [len(x) for x in found]
            flat += found
        order = np.concatenate([plain, others])
        starts = np.zeros(len(at), np.int64)
        starts[order] = np.cumsum(counts[order], dtype=np.int64) - counts[order]
        return counts, _gather(np.concatenate(flat), starts, counts)


class WholeEncoder:
    """The library's ids of whole texts, for any vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)
        ids = [np.asarray(e.ids, "<u4") for e in found]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])


#: What ``pieces_of`` knows of a file: white space is dropped, signs part from letters, case from neither.
_NORMALIZER = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_by_pieces(spec: dict) -> bool:
    """Whether a vocabulary file normalises and splits so that a text's ids are those of its pieces."""
    normal, split, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in normal.get("normalizers", ())]
    first, *rest = split.get("pretokenizers") or [{}]
    return (
        steps == _NORMALIZER and normal["normalizers"][1].get("content") == " " and spec["post_processor"] is None
        and first.get("pattern") == {"Regex": _SPLIT} and first.get("behavior") == "Removed" and bool(first.get("invert"))
        and len(rest) == 1 and rest[0].get("type") == "ByteLevel" and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex")
        and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and all(set("'<|>") & set(t["content"]) and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    )


def encoder_of(path: str) -> UnitEncoder | WholeEncoder:
    """The encoder of a vocabulary file, made once per process."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _encoders[path] = UnitEncoder(path) if parts_by_pieces(spec) else WholeEncoder(path)
    return _encoders[path]


_encoders: dict[str, UnitEncoder | WholeEncoder] = {}


#: Text bytes whose units are looked up at once.
_SLICE = 6 << 20


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, uri: str, path: str, end_id: int = 2) -> list[dict]:
    """Writes the ids of every whole text, each with ``end_id`` after it, below ``uri``.

    Documents are in ascending doc_id (an integer, else a TypeError) over all parts (null first; rows that share a doc_id by text);
    repeated rows are written as often as they come; null and empty texts are an end id alone. One
    shuffle, by ranges of doc_id; each range is a part. A task's file has a name of its own, and
    only files that succeeded come into ``manifest.json``, so tasks may be lost and run again.
    Returns the manifest: uri, first doc_id, documents, ids and start of each part.
    """
    integer_ids(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end, writer, first, target = np.asarray([end_id], "<u4"), None, None, ""
        for batch in batches:
            for a, b, _ in chunks(batch.column(1), _SLICE):
                ids, bounds = encoder(batch.column(1).slice(a, b - a))
                for d, x in zip(batch.column(0).slice(a, b - a).to_pylist(), np.split(ids, bounds[1:-1])):
                    if writer is None:
                        target, first = f"{uri}/part-{uuid.uuid4().hex}.ids", d
                        files, where = _filesystem(target)
                        writer = Writer(files.open_output_stream(where))
                    writer.add(d, np.concatenate([x, end]))
                # an executor may hold more workers than cores, and each keeps its encoder
                del ids, x
                relax()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"uri": [target], "first": pa.array([first], pa.int64()), "docs": [len(writer.docs)], "ids": [writer.total]})

    # a sorted range follows another; the exchange's pieces may be merged, but only with neighbours
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    parts = [r.asDict() for r in ordered.mapInArrow(run, "uri string, first bigint, docs bigint, ids bigint").collect()]  # one row per part
    parts.sort(key=lambda p: (p["first"] is not None, p["first"] or 0))
    start = 0
    for p in parts:
        p["start"] = start
        start += p["ids"]
    files, where = _filesystem(f"{uri}/manifest.json")
    with files.open_output_stream(where) as f:
        f.write(json.dumps(parts).encode())
    return parts


def read_token_files(spark: SparkSession, parts: list[dict], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and ids) of each document, from the files."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, where = _filesystem(uri)
                with files.open_input_file(where) as f:
                    rows: list[tuple] = []
                    for d, x in Reader(f):
                        x = x.astype("<u4")
                        rows.append((d, start, len(x), zlib.crc32(x.tobytes())) + ((x.astype(np.int64),) if with_ids else ()))
                        start += len(x)
                        if len(rows) >= 4096:
                            yield _rows(rows, with_ids)
                            rows = []
                    if rows:
                        yield _rows(rows, with_ids)

    if not parts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(p["uri"], p["start"]) for p in parts], "uri string, start bigint")
    return listed.repartitionByRange(len(parts), "start").mapInArrow(run, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = write_token_files(table(spark, sf_dir, "documents"), scratch_uri(spark), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, parts)


QUERIES = {"op10_token_files": op10_token_files}
ORACLE_SQL: dict[str, str] = {}
