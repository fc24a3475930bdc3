from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarmac.llm import licences

FOLDER = Path("/usr/share/common-licenses")
FILES = {n: n.removesuffix("-only") for n, _ in licences.LONG} | {"Artistic-1.0-Perl": "Artistic", "GPL-1.0-only": "GPL-1", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.0-only": "LGPL-2", "LGPL-3.0-only": "LGPL-3"}


def test_known_texts_in_other_spellings(documents):
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    bsd = next(t for n, t in licences.KNOWN if n == "BSD-3-Clause")
    rows = [
        (1, mit.upper()),
        (2, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.replace("\n", "\r\n  * ")),
        (3, bsd.replace("copyright holder", "copyright owner").replace("copyright holders".upper(), "COPYRIGHT OWNERS")),
        (4, mit + " and more"),
        (5, "Text.\n  RELEASED under the MIT Licence!!\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
        (6, "# SPDX-License-Identifier: Apache-2.0"),
        (7, None),
        (8, ""),
        (None, mit),
        (9, "This is not released under the MIT License."),
        (9, "Released under the MIT License."),
    ]
    got = {(r.doc_id, r.licence, tuple(r.notices)) for r in licences.scan(documents(rows)).collect()}
    assert got == {
        (1, "MIT", ()), (2, "MIT", ()), (3, "BSD-3-Clause", ()), (4, None, ()), (5, None, ("CC-BY-NC-4.0", "MIT")),
        (6, "Apache-2.0", ("Apache-2.0",)), (7, None, ()), (8, None, ()), (None, "MIT", ()), (9, None, ()), (9, "MIT", ("MIT",)),
    }


def test_odd_tables(spark, documents):
    assert licences.scan(documents([])).count() == 0
    own = licences.digests(spark, [("X-1", "You may do as you like, but sing.")])
    rows = licences.scan(documents([(1, "you may DO as you like -- but sing"), (2, "x\n" * 200_000)]), own).collect()
    assert {(r.doc_id, r.licence) for r in rows} == {(1, "X-1"), (2, None)}


def test_every_known_text_finds_itself(spark, documents):
    rows = list(enumerate(t for _, t in licences.catalogue()))
    got = {r.doc_id: r.licence for r in licences.scan(documents(rows)).collect()}
    by_digest = {}
    for n, t in licences.catalogue():
        by_digest.setdefault(t, n)
    assert [got[i] for i, _ in rows] == [by_digest[t] for _, t in rows]


def test_no_python_on_the_main_path(real):
    plan = licences.scan(real).withColumn("n", F.size("notices"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_texts_with_titles_and_wrapped_lines(documents):
    def of(name):
        return next(t for n, t in licences.KNOWN if n == name)

    wrapped = of("BSD-3-Clause").replace("THE COPYRIGHT HOLDERS AND", "THE\nCOPYRIGHT HOLDERS AND").replace("the above copyright notice", "the above\ncopyright notice")
    marked = of("BSD-2-Clause").replace("1. Redis", "(a) Redis")
    rows = [
        (1, "BSD 3-Clause License\n\nCopyright (c) 2019, Some People\nAll rights reserved.\n\n" + of("BSD-3-Clause")),
        (2, "ISC License\n\nCopyright 2001 by A. Person <a@b.example>\n\n" + of("ISC")),
        (3, wrapped),
        (4, "The MIT License (MIT)\n\n© A. Person\n" + of("MIT")),
        (5, "(c) 1999-2003 A. Person\nCopyright by A. Person\nCopyright A. Person, 2004\n" + of("Zlib")),
        (6, "Copyright is a right.\n" + of("Zlib")),
        (7, marked),
        (8, "(c) the third mark of a list\n" + of("MIT")),
        (9, "The whole software, all rights reserved by us.\n" + of("MIT")),
    ]
    got = {r.doc_id: r.licence for r in licences.scan(documents(rows)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "ISC", 3: "BSD-3-Clause", 4: "MIT", 5: "Zlib", 6: None, 7: None, 8: None, 9: None}


@pytest.mark.parametrize("name", sorted({n for n, _ in licences.LONG}))
def test_long_public_texts(documents, name):
    file = FOLDER / FILES.get(name, name)
    if not file.exists():
        pytest.skip("no such file here")
    text = file.read_text(errors="replace")
    rows = [(1, text), (2, text.upper()), (3, "\r\n".join("  " + line for line in text.split("\n"))), (4, text + "\nAnd more.")]
    got = {r.doc_id: r.licence for r in licences.scan(documents(rows)).collect()}
    assert got == {1: name, 2: name, 3: name, 4: None}


def test_nothing_but_the_known_texts_moves(real):
    """Lines are looked up within their row: no explode, no shuffle of lines or texts."""
    plan = licences.scan(real)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1


def test_a_table_of_ones_own_gives_each_row_its_notices(spark, documents):
    own = licences.digests(spark, [("X-1", "You may sing."), ("X-2", "You may dance.")])
    rows = [(1, "You may sing."), (1, "No."), (None, "you may dance\nYou may sing!"), (2, "you may dance\nno"), (2, "you may dance\nno")]
    got = sorted((str(r.doc_id), str(r.licence), tuple(r.notices)) for r in licences.scan(documents(rows), own).collect())
    assert got == sorted([("1", "X-1", ("X-1",)), ("1", "None", ()), ("None", "None", ("X-1", "X-2")), ("2", "None", ("X-2",)), ("2", "None", ("X-2",))])
