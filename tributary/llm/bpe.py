"""Byte-level BPE: encoding and decoding with a public vocabulary file.

A short word is held as one contiguous array of parts and one of the ranks of adjacent parts. The
minimum of the ranks is looked for again and again; its boundary is deleted and the two ranks beside
it are refreshed. For words of up to some hundred bytes this scan beats any heap; longer runs go
through a heap over a linked list. Words of equal length are merged at once, as rows of a matrix of
parts and one of ranks. Words repeat, so a task keeps results, up to a bound, and leaves none in its
process, which goes on to other work in what memory its executor has.

Files of another kind (a normaliser, another splitter, other flags) are left to the library.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .io import table
from .words import chunks, relax

SHORT = 160
#: Entries of a generation of a task's memories of space-led units and of words in them.
UNITS, PIECES = 80_000, 40_000
_NONE = 1 << 62
#: Words of one length that are merged as rows of a matrix; fewer go one by one. Rows at once.
ROWS, MOST_ROWS = 12, 1 << 14
#: Characters of the texts that are looked at together.
SLICE = 1 << 20

#: Letters and numbers of newer Unicode versions than the vocabulary's library knows: other signs to it.
_LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_later = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in _LATER)
#: The public split pattern, with letters and numbers as that library has them.
SPLIT = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_later}]]+| ?[\p{{N}}--[{_later}]]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{_later}])+|\s+(?!\S)|\s+")
#: Signs that are neither letters nor numbers and open no contraction.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class _Memory:
    """What was made lately: of two generations, the older goes when the younger is full."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def known(self, key):
        """The value of ``key``, or None."""
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.young[key] = value
        return value

    def keep_all(self, fresh: dict) -> None:
        if len(self.young) + len(fresh) > self.size:
            self.young, self.old = {}, self.young
        self.young |= fresh


class Pairs:
    """A hash table from pairs of ids to the rank and id of their merge, looked up by whole arrays."""

    def __init__(self, rank: dict[int, int]) -> None:
        bits = max(8, (4 * len(rank)).bit_length())
        self.shift, self.last, self.empty = np.uint64(64 - bits), np.int64((1 << bits) - 1), np.uint64((1 << 64) - 1)
        self.keys, self.values = np.full(1 << bits, self.empty), np.full(1 << bits, _NONE, np.int64)
        keys, values = np.fromiter(rank, np.uint64, len(rank)), np.fromiter(rank.values(), np.int64, len(rank))
        at = self._slots(keys)
        while len(keys):
            # the first of those that want an empty slot gets it; the others go on to the next
            free = np.flatnonzero(self.keys[at] == self.empty)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], at[rest] + 1 & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 24 | b).astype(np.uint64)
        at = self._slots(key)
        got = self.keys[at]
        out = np.where(got == key, self.values[at], _NONE)
        more = np.flatnonzero((got != key) & (got != self.empty))
        at = at.ravel()[more]
        key, flat = key.ravel(), out.ravel()
        while len(more):
            at = at + 1 & self.last
            got = self.keys[at]
            hit = got == key[more]
            flat[more[hit]] = self.values[at[hit]]
            go = ~hit & (got != self.empty)
            more, at = more[go], at[go]
        return flat.reshape(out.shape)


class ByteBpe:
    """A vocabulary with ranked merges, as in a byte-level ``tokenizers`` file."""

    def __init__(self, spec: dict) -> None:
        vocab, signs = spec["model"]["vocab"], _byte_signs()
        back = {s: b for b, s in signs.items()}
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of.extend([b""] * (i + 1 - len(self.bytes_of)))
            self.bytes_of[i] = token.encode()
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.byte_id = [vocab[signs[b]] for b in range(256)]
        # both parts' ids -> rank and the merged id in one integer, so that the least is the next merge
        self.rank = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[a] << 24 | vocab[b], k << 24 | vocab[a + b])
        self.pairs, self.byte_ids = Pairs(self.rank), np.asarray(self.byte_id, np.int64)
        self.token_data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.token_size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.pieces, self.spaced = _Memory(PIECES), _Memory(UNITS)

    def forget(self) -> None:
        """Empties the memories."""
        self.pieces, self.spaced = _Memory(self.pieces.size), _Memory(self.spaced.size)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        if len(word) > SHORT:
            return self._merge_long(word)
        parts, rank = [self.byte_id[b] for b in word], self.rank.get
        ranks = [rank(a << 24 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            parts[i] = new = least & 0xFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 24 | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank(new << 24 | parts[i + 1], _NONE)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        parts, n, rank = [self.byte_id[b] for b in word], len(word), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 24 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] << 24 | parts[j]) != r:
                continue
            parts[i], parts[j], after[i] = r & 0xFFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := rank(parts[a] << 24 | parts[b])) is not None:
                    heapq.heappush(heap, (x, a))
        return [p for p in parts if p >= 0]

    def _merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of one length, as bytes: ``merge`` for all at once, a boundary of each a step."""
        out = [b""] * len(words)
        parts = self.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        ranks, left = self.pairs(parts[:, :-1], parts[:, 1:]), np.arange(len(words))
        while len(left):
            row, width = np.arange(len(left)), parts.shape[1]
            at = ranks.argmin(axis=1) if width > 1 else row * 0
            least = ranks[row, at] if width > 1 else np.full(len(left), _NONE)
            if (done := least == _NONE).any():
                for k, ids in zip(left[done].tolist(), parts[done].astype("<u4")):
                    out[k] = ids.tobytes()
                parts, ranks, left, at, least = (x[~done] for x in (parts, ranks, left, at, least))
                row = row[: len(left)]
            if not len(left):
                break
            new = least & 0xFFFFFF
            parts[row, at] = new
            beyond = np.arange(width - 1) > at[:, None]
            parts = np.where(beyond, parts[:, 1:], parts[:, :-1])
            ranks = np.where(np.arange(width - 2) >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            for use, a, b in ((np.flatnonzero(at > 0), -1, 0), (np.flatnonzero(at < width - 2), 0, 1)):
                ranks[use, at[use] + a] = self.pairs(parts[use, at[use] + a], parts[use, at[use] + b])
        return out

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Ids of pre-split words, as bytes."""
        raw = [w.encode() for w in words]
        out, lengths = [b""] * len(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(raw) else ():
            if len(group) < ROWS or lengths[group[0]] > SHORT:
                for k in group.tolist():
                    out[k] = np.asarray(self.merge(raw[k]), "<u4").tobytes()
                continue
            for a in range(0, len(group), MOST_ROWS):
                some = group[a : a + MOST_ROWS].tolist()
                for k, ids in zip(some, self._merge_rows([raw[k] for k in some])):
                    out[k] = ids
        return out

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units that follow a space; empty for one that doesn't stand for itself."""
        split: dict[str, tuple[str, ...]] = {}
        for u in units:
            stem = u.rstrip(_MARKS)
            if stem.isalpha() and stem.isascii():
                split[u] = (" " + stem, u[len(stem) :]) if len(stem) < len(u) else (" " + stem,)
            elif u and not stem:
                split[u] = (" " + u,)
            else:
                # no split spans a single space between other signs
                split[u] = tuple(SPLIT.findall(" " + u)) if u and not u[0].isspace() and not u[-1].isspace() else ()
        ids = self._ids_of({p for s in split.values() for p in s})
        fresh = {u: b"".join([ids[p] for p in s]) for u, s in split.items()}
        self.spaced.keep_all(fresh)
        return fresh

    def _ids_of(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pre-split words; those met for the first time are merged together."""
        found = {p: v for p in pieces if (v := self.pieces.known(p)) is not None}
        missing = [p for p in pieces if p not in found]
        fresh = dict(zip(missing, self.merge_many(missing)))
        self.pieces.keep_all(fresh)
        found |= fresh
        return found

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; null is as empty."""
        out, crowded = [b""] * len(texts), {}
        whole = [(k, t.split(" ")) for k, t in enumerate(texts) if t and not any(s in t for s in self.special)]
        get, values, missing = self.spaced.young.get, [], set()
        for _, units in whole:
            found = list(map(get, units[1:]))
            values.append(found)
            if None in found:
                missing.update([u for u, f in zip(units[1:], found) if f is None])
        fresh = {u: v for u in missing if (v := self.spaced.old.get(u)) is not None}
        self.spaced.keep_all(fresh)
        fresh |= self._learn(missing.difference(fresh))
        for (k, units), found in zip(whole, values):
            if None in found:
                found = [fresh[u] if f is None else f for u, f in zip(units[1:], found)]
            if b"" in found:
                crowded[k] = SPLIT.findall(texts[k])
            elif units[0][-1:].isspace() or not units[0] and len(units) > 1:
                crowded[k] = SPLIT.findall(texts[k])
            else:
                crowded[k], out[k] = SPLIT.findall(units[0]), b"".join(found)
        ids = self._ids_of({p for pieces in crowded.values() for p in pieces})
        for k, pieces in crowded.items():
            out[k] = b"".join([ids[p] for p in pieces]) + out[k]
        for k, t in enumerate(texts):
            if t and any(s in t for s in self.special):
                parts = self.special_split.split(t)
                plain = iter(self.encode_many(parts[::2]))
                out[k] = b"".join(np.uint32(self.special[p]).astype("<u4").tobytes() if i % 2 else next(plain) for i, p in enumerate(parts))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        return self.decode_many([ids])[0]

    def decode_many(self, coded: list[bytes]) -> list[str]:
        """The texts of some lists of ids: the bytes of all tokens are gathered at once."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        size = self.token_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        at = np.repeat((self.token_start[ids] - ends[:-1]).astype(kind), size)
        at += np.arange(ends[-1], dtype=kind)
        data = self.token_data[at].tobytes()
        cut = ends[np.cumsum([0, *map(len, coded)]) // 4].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]


class LibraryBpe:
    """Any other ``tokenizers`` file, whole texts through the library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()

    def forget(self) -> None:
        """Nothing: the library bounds its own memory."""

    def encode(self, text: str | None) -> bytes:
        return np.asarray(self.library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)

    def decode_many(self, coded: list[bytes]) -> list[str]:
        return [self.decode(c) for c in coded]


def is_plain(spec: dict) -> bool:
    """Whether a file is of the kind that ``ByteBpe`` reads: split by the public pattern, no normaliser,
    bytes alone, and special tokens that are cut out as they are written."""
    model, split, out = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
    return (
        spec["normalizer"] is None
        and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        and out.get("type") == "ByteLevel" and spec["post_processor"] is None
        and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and set(_byte_signs().values()) <= model["vocab"].keys() and max(model["vocab"].values()) < 1 << 24
        and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )


_loaded: dict[str, ByteBpe | LibraryBpe] = {}


def vocabulary(path: str) -> ByteBpe | LibraryBpe:
    """The vocabulary of a file, loaded once per process."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _loaded[path] = ByteBpe(spec) if is_plain(spec) else LibraryBpe(path)
    return _loaded[path]


def _slices(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column, some at a time."""
    for a, b, _ in chunks(column, SLICE):
        yield column.slice(a, b - a).to_pylist()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of each row's whole text.

    Null and empty texts have no ids. Rows stay rows: repeated ones are encoded alike, an empty
    table gives an empty one, other columns are not read. Needs no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = [np.frombuffer(c, "<i4") for texts in _slices(batch.column(1)) for c in bpe.encode_many(texts)]
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i4"), *ids]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])
            del ids, lists
        bpe.forget()
        relax()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each whole text is encoded, and what the
    ids decode to is hashed beside them. Nulls and repeats as in ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = vocabulary(path), hashlib.sha256
        # many small objects and no cycles: scans for those only cost
        gc.disable()
        for batch in batches:
            n, coded, decoded = [], [], []
            for texts in _slices(batch.column(1)):
                ids = bpe.encode_many(texts)
                n += [len(x) // 4 for x in ids]
                coded += [sha(x).hexdigest() for x in ids]
                decoded += [sha(t.encode()).hexdigest() for t in bpe.decode_many(ids)]
                del texts, ids
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        gc.enable()
        bpe.forget()
        relax()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLE_SQL: dict[str, str] = {}
