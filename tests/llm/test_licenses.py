import pytest
from tributary.llm import licenses as L

from .cases import table

NOTICES = [
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("licensed under   the GNU General Public License,\nversion 2", "GPL-2.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("The license of this book was lost.", None),
    ("Licensed under the Foo License.", None),
]


@pytest.mark.parametrize("notice,license", NOTICES)
def test_notices_in_prose(spark, notice, license):
    prose = "Some ordinary words that say nothing about terms at all"
    docs = table(spark, [(1, f"{prose}.\n{notice}\n{prose}.", None, None, None, None, None, None, None, None)])
    assert L.scan_licenses(docs).first().license == license


def test_wording_differences():
    text = L._TEXTS["ISC"].replace("any purpose", "any lawful purpose")
    found = L.Scanner().judge(text)
    assert found.license == "ISC" and found.added == ("lawful",) and not found.missing


HEADER = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the {} as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version. */"""


@pytest.mark.parametrize("full,version,license", [("GNU General Public License", "3", "GPL-3.0"), ("GNU General Public License", "2", "GPL-2.0"), ("GNU Lesser General Public License", "2.1", "LGPL-2.1"), ("GNU Affero General Public License", "3", "AGPL-3.0"), ("GNU Library General Public License", "2", None)])
def test_standard_headers(full, version, license):
    scanner = L.Scanner()
    found = [scanner.judge(b) for b in scanner.blocks(HEADER.format(full, version))]
    assert [f and f.license for f in found] == [license]


@pytest.mark.parametrize("license", sorted(L._TEXTS))
def test_long_blocks_do_not_hide_a_text(license):
    around = "This software is free for any purpose and the copyright notice is in the documentation of this program. " * 40
    assert L.Scanner().judge(around + L._TEXTS[license] + " " + around).license == license


def test_openings_of_full_texts():
    for name, (full, version, date) in L._GNU.items():
        title = f"{full.upper()}\n  Version {version}, {date} Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy"
        scanner = L.Scanner()
        assert {f.license for f in map(scanner.judge, scanner.blocks(title)) if f} == {name}


MANY = [
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", {"MIT", "Apache-2.0"}),
    ("Licensed under the MIT License and the BSD 3-Clause License.", {"MIT", "BSD-3-Clause"}),
    ("Licensed under the Mozilla Public License, version 2.0, or the GPLv3 license, or the Eclipse Public License, version 2.0.", {"MPL-2.0", "GPL-3.0", "EPL-2.0"}),
    ("Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.", {"CC-BY-4.0", "CC-BY-SA-4.0"}),
    ("Licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
    ("Licensed under the MIT License and nothing that the Apache License, Version 2.0 says holds.", {"MIT"}),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT", "Apache-2.0"}),
]


@pytest.mark.parametrize("notice,licenses", MANY)
def test_adjacent_and_dual_notices(spark, notice, licenses):
    docs = table(spark, [(1, notice, None, None, None, None, None, None, None, None)])
    assert set(L.scan_licenses(docs).first().licenses) == licenses


def test_a_list_of_every_notice():
    scanner, names = L.Scanner(), {n: s[0] for n, s in L._NAMES.items()}
    text = "\n".join(f"Licensed under the {s}.".replace("under the CC", "under CC") for s in names.values())
    assert {f.license for b in scanner.blocks(text) for f in scanner.licenses(b)} == set(names)


def test_every_row_has_a_result(spark):
    got = L.scan_licenses(table(spark)).collect()
    assert len(got) == table(spark).count()
    assert all(r.n_blocks == 0 and r.license is None and r.licenses == [] for r in got)
    assert L.scan_licenses(table(spark, [])).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in L.op2_licenses(spark, sf_dir).collect():
        want = {i for s, i in (("under the MIT License", "MIT"), ("Apache License, Version 2.0", "Apache-2.0"), ("General Public License, version 3", "GPL-3.0"), ("CC BY-NC 4.0", "CC-BY-NC-4.0")) if s in docs[r.doc_id]}
        assert set(r.licenses) == want
