"""License scans by conditional compression.

Every template whose words of name and version are in a block of text is aligned with each place that
has them. The exact difference of the wording decides, and the place is compressed alone and with the
template as a zstandard raw-content dictionary: what it covers, not the block, is what it must reduce.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import table

#: Share of a template's words that may be missing, least reduction of the place that it covers.
MISSING, LEAST_REDUCTION = 0.12, 0.15

#: Without one of these no block is looked at. Runs as a built-in expression before any Python.
TRIGGER = r"(?i)licen[cs]e|copyright|public domain|permission is hereby|redistribution and use|creative ?commons|all rights reserved|\bCC[ -]BY|\bCC0|\b[al]?gpl|permission is granted to anyone|permission to use, copy"

_NAMES = {
    "MIT": ("MIT License", "MIT licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2 license"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3 license"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1 license"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3 license"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3 license"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0 license"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "EPL 2.0 license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "simplified BSD license"),
    "BSD-3-Clause": ("BSD 3-Clause License", "new BSD license"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero license"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
}
_PHRASES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This program is free software under the {}.")
_TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Headers of the GNU licenses, by name and version.
_GNU = {
    "GPL-2.0": ("GNU General Public License", "2", "June 1991 Copyright (C) 1989, 1991"),
    "GPL-3.0": ("GNU General Public License", "3", "29 June 2007 Copyright (C) 2007"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1", "February 1999 Copyright (C) 1991, 1999"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3", "29 June 2007 Copyright (C) 2007"),
    "AGPL-3.0": ("GNU Affero General Public License", "3", "19 November 2007 Copyright (C) 2007"),
}
_GNU_HEADERS = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.",
    "under the terms of the {0} as published by the Free Software Foundation; either version {1} of the License",
    "under the terms of the {0} as published by the Free Software Foundation; version {1}",
    "under the terms of the {0} version {1} as published by the Free Software Foundation",
    "under the terms of version {1} of the {0}",
    "{0} Version {1}, {2} Free Software Foundation, Inc.",
)
#: Headers and openings of full texts: license, name and version that must be there, wording.
_HEADERS = (
    ("Apache-2.0", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License, Version 2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL-2.0", "Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("EPL-2.0", "Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")."),
    ("BSL-1.0", "Boost Software License, Version 1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"),
    ("BSL-1.0", "Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
)
#: Names as tools and short notices write them.
_SHORT = {
    "MIT": ("MIT",),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0"),
    "GPL-2.0": ("GPL-2.0", "GPLv2", "GPL v2", "GPL version 2", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GPL-3.0", "GPLv3", "GPL v3", "GPL version 3", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL-2.1": ("LGPL-2.1", "LGPLv2.1", "LGPL v2.1", "LGPL version 2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "LGPL-3.0": ("LGPL-3.0", "LGPLv3", "LGPL v3", "LGPL version 3", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL-3.0": ("AGPL-3.0", "AGPLv3", "AGPL v3", "AGPL version 3", "AGPL-3.0-only", "AGPL-3.0-or-later"),
} | {n: (n,) for n in ("MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0")}
_TEXTS["Zlib"] = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
_TEXTS["BSD-3-Clause"] = _TEXTS["BSD-2-Clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
_COMMON = frozenset("licensed license licence released under the this work is distributed terms of program free software version v permission hereby granted by".split())


class Template(NamedTuple):
    license: str
    text: str
    words: tuple[str, ...]
    key: frozenset  # words that must all be there


def _words(text: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(text.lower()))


@cache
def templates() -> tuple[Template, ...]:
    """Every notice and text, in a fixed order."""
    out = []
    for name, spellings in _NAMES.items():
        for s in spellings:
            for p in _PHRASES:
                text = p.format(s).replace("under the CC", "under CC")
                out.append(Template(name, text.lower(), _words(text), frozenset(_words(s)) - _COMMON))
    for name, spellings in _SHORT.items():
        for s in spellings:
            for p in _PHRASES:
                out.append(Template(name, p.format(s).lower(), _words(p.format(s)), frozenset(_words(s)) - _COMMON))
            tag = _words(f"SPDX-License-Identifier: {s}")
            out.append(Template(name, " ".join(tag), tag, frozenset(tag)))
    for name, (full, version, date) in _GNU.items():
        for h in _GNU_HEADERS:
            text = h.format(full, version, date)
            out.append(Template(name, text.lower(), _words(text), frozenset(_words(f"{full} {version}")) - _COMMON))
    for name, key, text in _HEADERS:
        out.append(Template(name, text.lower(), _words(text), frozenset(_words(key)) - _COMMON))
    for name, text in _TEXTS.items():
        out.append(Template(name, text.lower(), _words(text), frozenset()))
    return tuple(out)


@cache
def _foreign() -> dict[str, frozenset]:
    """By license, the words of other licenses' names and versions that aren't in its own."""
    keys: dict[str, set] = {}
    for t in templates():
        keys.setdefault(t.license, set()).update(t.key)
    every = {"library", "documentation"}.union(*keys.values()) - {"spdx-license-identifier"}
    return {name: frozenset(every - own) for name, own in keys.items()}


@cache
def _grams() -> tuple[dict, ...]:
    """Of each template without a key: its runs of four words and their places."""
    return tuple({t.words[i : i + 4]: i for i in range(len(t.words) - 3)} if not t.key else {} for t in templates())


_JOINS = frozenset("or and either both of the a also under dual alternatively at your option terms license licence licenses licences".split())


def _joins(words: tuple[str, ...]) -> bool:
    """Whether the words between two names make one notice of them."""
    return bool({"or", "and"} & set(words)) and _JOINS.issuperset(words)


@cache
def _spellings() -> dict[str, list[tuple[tuple[str, ...], Template]]]:
    """Names by their first word, the longest first, each with a template that has it."""
    out: dict[str, list] = {}
    for t in templates():
        if t.text.startswith("licensed under ") and t.text.count(" ") < 12:
            name = t.words[3 if t.words[2] == "the" else 2 :]
            out.setdefault(name[0], []).append((name, t))
    return {w: sorted(found, key=lambda f: -len(f[0])) for w, found in out.items()}


def _names_at(words: tuple[str, ...]) -> list[tuple[Template, int, int]]:
    """Template and bounds of each name, spelled in full, in the words."""
    out, free = [], 0
    for i, w in enumerate(words):
        for name, t in _spellings().get(w, ()):
            if i >= free and words[i : i + len(name)] == name:
                out.append((t, i, i + len(name)))
                free = i + len(name)
                break
    return out


class Found(NamedTuple):
    license: str
    reduction: float
    missing: tuple[str, ...]
    added: tuple[str, ...]


class Scanner:
    """Compressors of one process."""

    def __init__(self) -> None:
        self.params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=14, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(compression_params=self.params)
        self.trigger = re.compile(TRIGGER)
        self.vocabulary = frozenset(w for t in templates() for w in t.words)
        self.known: dict[str, list[Found]] = {}

    def blocks(self, text: str) -> list[str]:
        """Runs of neighbouring sentences or lines that speak mostly in the templates' words and hold a trigger."""
        out, run = [], []
        for part in re.split(r"(?<=[.!?:;])\s+|\n+", text):
            words = _words(part)
            hit = self.trigger.search(part) is not None
            if hit or (words and sum(w in self.vocabulary for w in words) >= 0.7 * len(words)):
                run.append((part, hit))
                continue
            if any(h for _, h in run):
                out.append(" ".join(p for p, _ in run))
            run = []
        if any(h for _, h in run):
            out.append(" ".join(p for p, _ in run))
        return out

    def judge(self, block: str) -> Found | None:
        """The confirmed template that covers most with the least difference, if one does."""
        return next(iter(self.licenses(block)), None)

    def licenses(self, block: str) -> list[Found]:
        """What is found at the block's different places, each license once and the best first; the same blocks come again and again."""
        block = " ".join(block.lower().split())
        if block not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[block] = self._licenses(block)
        return self.known[block]

    def _licenses(self, block: str) -> list[Found]:
        words, kept = _words(block), []
        for _, _, found, a, b in sorted(self._fits(block), key=lambda f: f[:2], reverse=True):
            if all(b <= c or a >= d or found.license == k.license for k, c, d in kept):
                kept.append((found, a, b))
        # names that "and" or "or" joins to a notice share its wording
        names = [n for n in _names_at(words) if kept and all(n[2] <= c or n[1] >= d for _, c, d in kept)]
        joined = True
        while joined:
            joined = [n for n in names if any(_joins(words[d : n[1]] if n[1] >= d else words[n[2] : c]) for _, c, d in kept)]
            names = [n for n in names if n not in joined]
            kept += [(Found(t.license, round(self._reduction(t, words[a:b]), 6), (), ()), a, b) for t, a, b in joined]
        out: dict[str, Found] = {}
        for found, _, _ in kept:
            out.setdefault(found.license, found)
        return list(out.values())

    def _fits(self, block: str) -> list[tuple[int, float, Found, int, int]]:
        """Each template at each place that it fits: words that match less those that differ, reduction,
        what is found, and the bounds of its words."""
        words, out, at = _words(block), [], {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        for k, t in enumerate(templates()):
            if not all(w in at for w in t.key):
                continue
            slack, n = max(6, len(t.words) // 2), len(t.words)
            if t.key:
                rare = min(t.key, key=lambda w: (len(at[w]), w))
                starts = [i - t.words.index(rare) for i in at[rare]]
            else:
                grams, starts = _grams()[k], []
                for s in sorted(i - grams[words[i : i + 4]] for i in range(len(words) - 3) if words[i : i + 4] in grams):
                    if not starts or s > starts[-1] + slack:
                        starts.append(s)
            for s in starts:
                lo = max(0, s - slack)
                fit = self._fit(t, words[lo : max(0, s + n + slack)], lo)
                if fit:
                    out.append(fit)
        return out

    def _fit(self, t: Template, words: tuple[str, ...], lo: int) -> tuple[int, float, Found, int, int] | None:
        # runs that template and text share; a word of another license's name parts them
        runs, foreign = [[]], _foreign()[t.license] if t.key else frozenset()
        for a, b, n in difflib.SequenceMatcher(None, t.words, words, autojunk=False).get_matching_blocks()[:-1]:
            if runs[-1] and foreign.intersection(words[runs[-1][-1][1] + runs[-1][-1][2] : b]):
                runs.append([])
            runs[-1].append((a, b, n))
        run = max(runs, key=lambda r: sum(n for _, _, n in r))
        if not run:
            return None
        have = {i for a, _, n in run for i in range(a, a + n)}
        missing = tuple(w for i, w in enumerate(t.words) if i not in have)
        if len(missing) > max(1, MISSING * len(t.words)) or not t.key <= {t.words[i] for i in have}:
            return None
        added = tuple(w for (_, b, n), (_, c, _) in zip(run, run[1:]) for w in words[b + n : c])
        first, last = run[0][1], run[-1][1] + run[-1][2]
        reduction = self._reduction(t, words[first:last])
        if reduction < LEAST_REDUCTION:
            return None
        return len(have) - len(missing) - len(added), reduction, Found(t.license, round(reduction, 6), missing, added), lo + first, lo + last

    def _reduction(self, t: Template, words: tuple[str, ...]) -> float:
        data = " ".join(words).encode()
        d = zstandard.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        alone = len(self.plain.compress(data))
        return (alone - len(zstandard.ZstdCompressor(compression_params=self.params, dict_data=d).compress(data))) / alone


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_blocks, licenses (distinct, sorted), and of the notice that its template
    reduces most: license, reduction of the notice's words, missing and added words.

    Only texts with a trigger word reach Python. Null or empty texts, and texts without a notice, have
    no licenses, null license and reduction, and empty word lists; ``n_blocks`` counts blocks looked
    at, confirmed or not. Ties go to the first block. Rows stay rows; other columns aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_blocks bigint, licenses array<string>, license string, reduction double, missing array<string>, added array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                blocks = scanner.blocks(t.as_py()) if t.is_valid else []
                found = [f for b in blocks for f in scanner.licenses(b)]
                best = max(found, key=lambda f: f.reduction, default=None)
                rows.append((len(blocks), sorted({f.license for f in found}), best.license if best else None, best.reduction if best else None, list(best.missing) if best else [], list(best.added) if best else []))
            kinds = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_blocks", "licenses", "license", "reduction", "missing", "added"])

    return docs.select("doc_id", F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("text")).mapInArrow(run, schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op2_licenses": op2_licenses}
ORACLE_SQL: dict[str, str] = {}
