"""License scans on planted wordings."""

import re
import textwrap

from vecsnap.llm import licenses

MIT = licenses.TEMPLATES["MIT"][0]


def test_planted(spark, odd):
    edited = MIT.replace("Software is furnished", "Program is supplied")
    rows = [
        (1, "prose before\n" + MIT + "\n\nprose after"),
        (2, "a\n" + re.sub(r"((?:\S+ ){8})", r"\1\n", edited) + "\n\nz"),
        (3, "Released under the MIT License.\nplain prose"), (4, "x\nLicensed under the Apache License, Version 2.0."),
        (5, "a driver license is needed to park here"), (None, "SPDX-License-Identifier: MIT"), (6, None), (7, ""),
        (8, "copyright " * 20_000), (3, "Released under the MIT License.\nplain prose"),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r["doc_id"], r["license"], r["exact"]) for r in out), key=str)
    want = [(1, "MIT", True), (2, "MIT", False), (3, "MIT", True), (3, "MIT", True), (4, "Apache-2.0", True), (None, "MIT", True)]
    assert got == sorted(want, key=str)
    two = next(r for r in out if r["doc_id"] == 2)
    assert "program" in two["added"] and "supplied" in two["added"] and "furnished" in two["missing"]
    assert all(r["saved"] > 0 for r in out)
    assert licenses.scan(odd).count() == 0


def test_documents(small, empty):
    """Every license line of the tables is found, and nothing else."""
    out = licenses.scan(small).select("doc_id", "first_line").collect()
    lines = {
        (r["doc_id"], i) for r in small.collect() for i, x in enumerate(r["text"].split("\n"))
        if re.match(r"Released under the|Licensed under|This work is licensed|All rights reserved", x)
    }
    assert {(r["doc_id"], r["first_line"]) for r in out} == lines and lines
    assert licenses.scan(empty).count() == 0


def test_scattered_words_are_no_statement():
    """The words of a notice spread over a long line are chance; close ones are the notice, reworded."""
    tool, candidate = licenses.Templates(licenses.TEMPLATES), re.compile(licenses.CANDIDATE)
    filler = " ".join(f"w{i}" for i in range(40))
    scattered = f" {filler} ".join(["released", "under", "the", "mit", "license"])
    assert tool.scan(scattered, candidate) == []
    (found,) = tool.scan(f"{scattered} {filler} Released under the terms of the MIT License. {filler}", candidate)
    assert found[2] == "MIT" and "terms" in found[7] and len(found[7].split(" ")) <= 4


def test_statements_in_long_lines():
    """Several statements within one line of any length are all found."""
    tool, candidate = licenses.Templates(licenses.TEMPLATES), re.compile(licenses.CANDIDATE)
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    for n in (20, 2_000, 20_000):
        filler = " ".join(f"w{i * 7919 % 10_007}" for i in range(n))
        text = " ".join([filler, apache, filler, MIT, filler, "Released under the MIT License.", filler])
        assert [(r[0], r[2], r[3], r[8]) for r in tool.scan(text, candidate)] == [
            (0, "Apache-2.0", 1, True), (0, "MIT", 0, True), (0, "MIT", 1, True)]
    close = "Released under the MIT License. " * 500 + apache
    assert len(tool.scan(close, candidate)) == 501


def test_published_layouts():
    """Blank lines between paragraphs, list items and license lines right before belong to no end."""
    tool, candidate = licenses.Templates(licenses.TEMPLATES), re.compile(licenses.CANDIDATE)
    mit = MIT.replace(" The above copyright", "\n\nThe above copyright")
    bsd = licenses.TEMPLATES["BSD-3-Clause"][0]
    for k in "123":
        bsd = bsd.replace(f" {k}. ", f"\n\n{k}. ")
    apache = licenses.TEMPLATES["Apache-2.0"][0].replace(" You may obtain", "\nYou may obtain")
    apache = apache.replace(" http", "\n\n    http").replace(" Unless", "\n\nUnless")
    wrap = lambda text: "\n".join(textwrap.fill(x, 70) for x in text.split("\n"))
    for name, text in (("MIT", mit), ("BSD-3-Clause", bsd), ("Apache-2.0", apache)):
        head = "The Project\n\nCopyright (c) 2020 Somebody\n\n"
        (found,) = tool.scan(head + wrap(text) + "\n\nprose after", candidate)
        assert found[2:4] == (name, 0) and found[8]
        # Lines with license words ahead take no lines from the statement.
        (found,) = tool.scan("see copyright\n" * 20 + wrap(text), candidate)
        assert found[2:4] == (name, 0) and found[0] == 20


def test_compression_selects():
    """Of statements that overlap, the one that its template compresses most counts, in any case and layout."""
    short, long = "a b c d e f license", "license extraordinary documentation distribution"
    tool, candidate = licenses.Templates({"short": [short], "long": [long]}), re.compile(licenses.CANDIDATE)
    for text in (f"a b c d e f {long}", f"A B C D E F {long.upper()}"):
        (found,) = tool.scan(text, candidate)
        assert found[2] == "long" and found[8]
    assert [r[2] for r in tool.scan(f"{short}\n{long}", candidate)] == ["short", "long"]
