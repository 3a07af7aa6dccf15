"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders; windows of the canonical words of each benchmark
item are looked up by hash in every document. Where an item's windows match but its wording doesn't,
the slots decide: a re-parameterised copy puts the same new value wherever the item repeats one. Runs
of the words as written, without placeholders and case, are looked up too, so that a verbatim copy is
found whatever its slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import stored, table
from .words import _BYTE, _SPACE, LOWER, Text, Words, _byte_powers, chunks, mix, owners, relax, windows

#: Words of a window; of these at least so many that aren't placeholders.
WINDOW, PLAIN = 8, 4
#: An item is in a document, with whatever values, that has so many of its windows (all, if it has
#: fewer) and such a share. One literal run is enough, however long the item.
LEAST_WINDOWS, LEAST_SHARE = 6, 0.3
#: Words of a literal run; a shorter item is one run.
RUN = 14
#: Share of repeated slots that must agree in a copy with other values.
CONSISTENT = 0.9
#: Windows of a benchmark that are sent to the executors at once (some 32 bytes each, and as much for
#: literal runs); a larger benchmark is split by items, and each part is looked up in a pass of its own.
MAX_INDEX = 1_000_000

UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees celsius fahrenheit kelvin hz khz mhz ghz watt watts kw volt volts amp amps joule joules newton newtons pascal pascals byte bytes kb mb gb tb mph kmh".split()
NUMBER, NAME, UNIT = np.uint64(0x6E756D), np.uint64(0x6E616D65), np.uint64(0x756E6974)

_digit, _upper, _punct, _ender = (np.zeros(256, bool) for _ in range(4))
_digit[48:58] = True
_upper[65:91] = True
_punct[:128] = [not (chr(b).isalnum() or _SPACE[b]) for b in range(128)]
_ender[[ord(c) for c in ".!?:;\n\r"]] = True


#: Lower case of the letters that take two or three bytes, where it takes as many.
_lower = np.arange(1 << 16, dtype=np.uint16)
for _c in range(0x80, 1 << 16):
    _l = chr(_c).lower()
    if len(_l) == 1 and ord(_l) < 1 << 16 and (_c < 0x800) == (0x80 <= ord(_l) < 0x800):
        _lower[_c] = ord(_l)


class Canonical(NamedTuple):
    """words: canonical words and bounds of documents in them; literal: hashes of the words as
    written, without case and punctuation; slot: which words are placeholders; spelled: all words,
    each name of a run by itself, by their literal hashes."""

    words: Words
    literal: np.ndarray
    slot: np.ndarray
    spelled: Words


def _folded(data: np.ndarray) -> np.ndarray:
    """The bytes in lower case."""
    low = LOWER[data]
    two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if len(two):
        c = _lower[(data[two] & 0x1F).astype(np.uint16) << 6 | data[two + 1] & 0x3F]
        low[two], low[two + 1] = 0xC0 | c >> 6, 0x80 | c & 0x3F
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    if len(three):
        c = _lower[(data[three] & 0x0F).astype(np.uint16) << 12 | (data[three + 1] & 0x3F).astype(np.uint16) << 6 | data[three + 2] & 0x3F]
        low[three], low[three + 1], low[three + 2] = 0xE0 | c >> 12, 0x80 | c >> 6 & 0x3F, 0x80 | c & 0x3F
    return low


def canonical(text: Text) -> Canonical:
    """Typed words of a chunk of documents; names that follow each other count as one."""
    data = text.data
    n = len(data)
    wide = np.zeros(n, bool)  # second byte of an upper-case letter of Latin-1
    if n > 1:
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    upper = _upper[data]
    low = _folded(data)
    if n > 1:
        upper[:-1] |= wide[1:]
    kept = np.flatnonzero(~_punct[data])
    small = low[kept]
    offsets = np.searchsorted(kept, text.offsets)
    space = _SPACE[small]
    before, after = np.ones(len(small), bool), np.ones(len(small), bool)
    if len(small):
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = offsets[1:-1]
        before[inner[inner < len(small)]] = True
        after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _byte_powers(len(small) + 1)
    sums = np.zeros(len(small) + 1, np.uint64)
    np.cumsum(_BYTE[small] * up[:-1], out=sums[1:])
    literal = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    digits = np.zeros(len(small) + 1, np.int32)
    np.cumsum(_digit[small], out=digits[1:])
    number = digits[ends] > digits[starts]
    at, to = kept[starts] if len(kept) else starts, kept[ends - 1] if len(kept) else ends
    enders = np.zeros(n + 1, np.int32)
    np.cumsum(_ender[data], out=enders[1:])
    sentence = np.ones(len(starts), bool)
    sentence[1:] = enders[at[1:]] > enders[to[:-1]]
    sentence[first[:-1][first[:-1] < len(starts)]] = True
    # capitalised, but neither a sentence's first word nor all in capitals
    second = np.minimum(at + 1 + (data[np.minimum(at, n - 1)] >= 0x80), max(n - 1, 0)) if n else at
    shouted = upper[second] & (second <= to) if n else sentence
    name = (upper[at] if n else sentence) & ~sentence & ~shouted & ~number
    unit = np.isin(literal, _unit_hashes()) & ~number
    hashes = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, literal)))
    again = np.zeros(len(starts), bool)
    again[1:] = name[1:] & name[:-1]
    again[first[:-1][first[:-1] < len(starts)]] = False
    use = ~again
    place = np.concatenate([[0], np.cumsum(use)])
    slot = number | unit | name
    return Canonical(Words(at[use], to[use] + 1, place[first], hashes[use]), literal[use], slot[use], Words(at, to + 1, first, literal))


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        _units.append(np.zeros(0, np.uint64))  # while the units' own hashes are made
        column = pa.array(UNITS, pa.large_string())
        _units[0] = np.unique(np.concatenate([canonical(t).literal for _, _, t in chunks(column)]))
    return _units[0]


def _template_windows(c: Canonical) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes, and where a window lies in one document and has enough plain words. A document
    of fewer words has none."""
    hashes, fits = windows(c.words, WINDOW)
    plain = np.concatenate([[0], np.cumsum(~c.slot)])
    n = len(hashes)
    if n >= WINDOW:
        fits[: n - WINDOW + 1] &= plain[WINDOW:] - plain[: n - WINDOW + 1] >= PLAIN
    return hashes, fits


class Runs(NamedTuple):
    """Literal runs of one length, by hash: the item of each; and which low bits of hashes occur."""

    hash: np.ndarray
    item: np.ndarray
    low: np.ndarray


class Index(NamedTuple):
    """Windows of some items, by hash: item and place of each; and every item's words. Literal runs
    of each length, and their number of each item."""

    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: list
    total: np.ndarray
    literal: list[np.ndarray]
    slot: list[np.ndarray]
    runs: dict[int, Runs]
    run_total: np.ndarray


def _runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Literal runs of ``length`` words, of all documents that have so many."""
    return (words.hash, np.ones(len(words.hash), bool)) if length == 1 else windows(words, length)


def index_items(rows: list[tuple]) -> Index:
    """An index of (item_id, text) rows. Items of fewer words than a window have a literal run only,
    those without words none."""
    column = pa.array([t for _, t in rows], pa.large_string())
    hashes, items, places, literal, slot = [], [], [], [], []
    runs: dict[int, list] = {}
    for a, b, text in chunks(column):
        c = canonical(text)
        h, fits = _template_windows(c)
        owner = owners(c.words.first)
        hashes.append(h[fits])
        items.append(owner[fits] + a)
        places.append((np.arange(len(h)) - c.words.first[owner])[fits])
        size = np.minimum(np.diff(c.spelled.first), RUN)
        owner = owners(c.spelled.first)
        for length in np.unique(size[size > 0]).tolist():
            h, fits = _runs(c.spelled, length)
            fits = fits & (size[owner] == length)
            runs.setdefault(length, []).append((h[fits], owner[fits] + a))
        for k in range(b - a):
            s = slice(c.words.first[k], c.words.first[k + 1])
            literal.append(c.literal[s])
            slot.append(c.slot[s])
    h, i, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, items, places))
    order = np.argsort(h, kind="stable")
    total = np.bincount(i.astype(np.int64), minlength=len(rows))
    by_length, run_total = {}, np.zeros(len(rows), np.int64)
    for length, found in runs.items():
        g, j = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(g, kind="stable")
        low = np.zeros(1 << min(24, max(12, (16 * len(g)).bit_length())), bool)
        low[g & np.uint64(len(low) - 1)] = True
        by_length[length] = Runs(g[by], j[by].astype(np.int64), low)
        run_total += np.bincount(j.astype(np.int64), minlength=len(rows))
    return Index(h[order], i[order].astype(np.int64), p[order].astype(np.int64), [k for k, _ in rows], total, literal, slot, by_length, run_total)


def _found(index: Index, c: Canonical) -> Iterator[tuple[int, int, str, int, int, int, int]]:
    """(document, item, kind, windows, windows matched, slots, slots that agree) for a chunk."""
    told = set()
    for row in _by_template(index, c):
        told.add(row[:2])
        yield row
    for doc, i, matched in _by_runs(index, c.spelled):
        if (doc, i) not in told:
            yield doc, i, "exact", int(index.run_total[i]), matched, 0, 0


def _by_runs(index: Index, words: Words) -> Iterator[tuple[int, int, int]]:
    """(document, item, literal runs of the item that the document has)."""
    owner = owners(words.first)
    for length, runs in index.runs.items():
        h, fits = _runs(words, length)
        at = np.flatnonzero(fits & runs.low[h & np.uint64(len(runs.low) - 1)])
        lo = np.searchsorted(runs.hash, h[at])
        equal = runs.hash[np.minimum(lo, len(runs.hash) - 1)] == h[at]
        at, lo = at[equal], lo[equal]
        if not len(at):
            continue
        # a run that a document repeats counts once
        doc, lo = np.divmod(np.unique(owner[at] * len(runs.hash) + lo), len(runs.hash))
        many = np.searchsorted(runs.hash, runs.hash[lo], "right") - lo
        entry = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs, matched = np.unique(np.repeat(doc, many) * len(index.ids) + runs.item[entry], return_counts=True)
        for pair, n in zip(pairs.tolist(), matched.tolist()):
            yield *divmod(pair, len(index.ids)), n


def _by_template(index: Index, c: Canonical) -> Iterator[tuple[int, int, str, int, int, int, int]]:
    h, fits = _template_windows(c)
    lo = np.searchsorted(index.hash, h)
    hit = np.flatnonzero(fits & (lo < len(index.hash)) & (index.hash[np.minimum(lo, len(index.hash) - 1)] == h)) if len(index.hash) else np.zeros(0, np.int64)
    if not len(hit):
        return
    hi = np.searchsorted(index.hash, h[hit], "right")
    many = hi - lo[hit]
    at = np.repeat(hit, many)
    entry = np.repeat(lo[hit], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    doc, item, place = owners(c.words.first)[at], index.item[entry], index.place[entry]
    order = np.lexsort((place, item, doc))
    at, doc, item, place = at[order], doc[order], item[order], place[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True]]))
    for a, b in zip(cut, cut[1:]):
        i, total = int(item[a]), int(index.total[item[a]])
        matched = len(np.unique(place[a:b]))
        if matched < min(total, max(LEAST_WINDOWS, math.ceil(LEAST_SHARE * total))):
            continue
        # words of the matched windows, the item's beside the document's
        mine = (place[a:b, None] + np.arange(WINDOW)).ravel()
        theirs = (at[a:b, None] + np.arange(WINDOW)).ravel()
        pairs = np.unique(np.stack([mine, theirs]), axis=1)
        x, y, s = index.literal[i][pairs[0]], c.literal[pairs[1]], index.slot[i][pairs[0]]
        if len(np.unique(pairs[0][x == y])) == len(np.unique(pairs[0])):
            yield int(doc[a]), i, "exact", total, matched, int(s.sum()), int(s.sum())
            continue
        values, back = np.unique(x[s], return_inverse=True)
        usual = [np.unique(y[s][back == k], return_counts=True)[1].max() for k in range(len(values))]
        slots, agree = int(s.sum()), int(sum(usual))
        if agree >= CONSISTENT * slots:
            yield int(doc[a]), i, "reparameterised", total, matched, slots, agree


_SCHEMA = "item_id {item}, kind string, n_windows bigint, n_matched bigint, n_slots bigint, n_consistent bigint"


def find_items(docs: DataFrame, benchmark: DataFrame, max_index: int = MAX_INDEX) -> DataFrame:
    """A row for each document and benchmark item that it holds, exactly or with other values:
    doc_id, item_id, kind, n_windows of the item, n_matched of them, n_slots and n_consistent. Where
    only the words as written tell a copy, its windows are literal runs and it has no slots: RUN words
    in a row of an item of any length, or the whole of a shorter one, are a copy.

    Whole texts are looked at, a document in one task, so nothing is shuffled. Null and empty texts
    hold nothing, and items without words are in none. An item of few words, or one, is in each text
    that has just these next to each other. Repeated rows each
    give their own; an empty table on either side gives an empty result. Other columns aren't read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (docs.schema["doc_id"], benchmark.schema["item_id"])}
    schema = f"doc_id {kinds['doc_id']}, " + _SCHEMA.format(item=kinds["item_id"])
    found = None
    for index, more in _indexes(benchmark, max_index):
        one = docs.select("doc_id", "text").mapInArrow(_looker(index), schema)
        if more or found is not None:
            one = stored(one)
            index.destroy()
        found = one if found is None else found.unionAll(one)
    return found


def _indexes(benchmark: DataFrame, max_index: int) -> Iterator[tuple[Broadcast, bool]]:
    """The index of each part of the benchmark, sent to the executors, and whether another follows. A
    part's rows are fetched when its turn comes, so the driver holds one part, however many there are."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    # every word has a character and a gap, so this bounds the windows of a part
    parts = max(1, math.ceil(size / 2 / max_index))
    for part in range(parts):
        rows = sorted(((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()), key=lambda r: (r[0] is not None, r))
        yield benchmark.sparkSession.sparkContext.broadcast(index_items(rows)), part < parts - 1


def _looker(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            rows, at = [], []
            for a, _, text in chunks(batch.column(1)):
                for doc, i, *rest in _found(ix, canonical(text)):
                    at.append(a + doc)
                    rows.append((ix.ids[i], *rest))
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            kinds = (None, pa.string(), *[pa.int64()] * 4)
            columns += [pa.array([r[k] for r in rows], t) if rows else pa.array([], t or pa.int64()) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "kind", "n_windows", "n_matched", "n_slots", "n_consistent"])
            relax()

    return run


def _judge(index):
    @F.pandas_udf("boolean")
    def judge(texts: pd.Series) -> pd.Series:
        found = np.zeros(len(texts), bool)
        for a, _, chunk in chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
            for doc, *_ in _found(index.value, canonical(chunk)):
                found[a + doc] = True
        relax()
        return pd.Series(found)

    return judge


def without_items(docs: DataFrame, benchmark: DataFrame, max_index: int = MAX_INDEX) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose text holds no item (see find_items)."""
    for index, more in _indexes(benchmark, max_index):
        docs = docs.where(~_judge(index)(F.col("text")))
        if more:
            docs = stored(docs)
            index.destroy()
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLE_SQL: dict[str, str] = {}
