import re

import pytest
from corpus_fixtures import LONG, TEXTS, documents, empty, rows
from tidemark.llm import license_scan as scan

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = WORDS.findall((text or "").translate(LOWER))
    hits = [(i, label) for phrase, label in scan.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in hits]
    return (len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in hits})))


TRICKY = [
    "mit license mit license", "The MIT-License; apache\nLICENSE", "mit licensed", "MIT  license", "gnu general public license general public license",
    "premit license", "mit\u00a0license", "mit license" * 3, "Ümit license é mit license", "a mit\x00license", LONG + " mit license " + LONG + " apache license",
]


@pytest.mark.parametrize("text", [t for _, t in TEXTS] + TRICKY)
def test_base_columns(text):
    found = scan.scan(text)
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], ",".join(found["base_labels"])) == brute(text)
    assert set(found["base_labels"]) <= set(found["labels"]) and 0 <= found["score"] <= 1


@pytest.mark.parametrize("expression, polish, permissive", [
    ("MIT", ["MIT"], True),
    ("MIT OR GPL-2.0-only", ["MIT", "GPL-2.0-only", "or"], True),
    ("MIT AND GPL-2.0-only", ["MIT", "GPL-2.0-only", "and"], False),
    ("MIT OR GPL-2.0 AND GPL-3.0", ["MIT", "GPL-2.0", "GPL-3.0", "and", "or"], True),
    ("(MIT OR GPL-2.0) AND GPL-3.0", ["MIT", "GPL-2.0", "or", "GPL-3.0", "and"], False),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0", "Classpath-exception-2.0", "with", "MIT", "or"], True),
    ("apache-2.0 and (bsd-3-clause or (isc))", ["apache-2.0", "bsd-3-clause", "isc", "or", "and"], True),
    ("MIT */", ["MIT"], True),
    ("MIT)", ["MIT"], True),
])
def test_expressions(expression, polish, permissive):
    assert scan.parse(expression) == polish and scan.evaluate(polish) is permissive


@pytest.mark.parametrize("expression", ["", "AND MIT", "MIT OR", "(MIT", "()", "MIT OR AND X", "*"])
def test_malformed(expression):
    assert scan.parse(expression) is None


def test_tags_and_notices():
    found = scan.scan("// SPDX-License-Identifier: LGPL-2.1+ WITH Foo-exception OR Zlib\nRedistribution and use in source and binary forms")
    assert found["labels"] == ["bsd", "lgpl", "zlib"] and found["permissive"] is True and found["n_base"] == 0
    assert scan.scan("SPDX-License-Identifier: MIT OR\n")["labels"] == ["mit"]
    assert scan.scan("Licensed under CC BY-NC 4.0.")["labels"] == ["cc-by", "cc-by-nc"]


def test_every_tag_is_read():
    """Tags on one line, expressions of any length, tags broken over a line."""
    found = scan.scan("SPDX-License-Identifier: MIT code here. SPDX-License-Identifier: GPL-3.0-only")
    assert found["labels"] == ["gpl", "mit"] and found["expressions"] == ["MIT", "GPL-3.0-only"] and found["permissive"] is False
    found = scan.scan("SPDX-License-Identifier: " + "MIT AND " * 200 + "GPL-3.0-only, see there")
    assert found["labels"] == ["gpl", "mit"] and found["permissive"] is False and found["expressions"][0].count("MIT") == 200
    found = scan.scan("// SPDX-License-\n// Identifier: GPL-2.0-only\nSPDX-License-Identifier:\n SPDX license identifier ISC\r\nMIT")
    assert found["labels"] == ["gpl", "isc"] and found["permissive"] is False
    assert scan.scan("SPDX-License-Identifier: MIT\nxspdx-license-identifier: GPL-2.0 spdx-license-identifiers: AGPL-3.0")["labels"] == ["mit"]


def test_identifiers_of_nested_expressions():
    polish = scan.parse("A OR (B WITH X AND (C OR D)) WITH Y AND E")
    assert scan.identifiers(polish) == ["A", "B", "C", "D", "E"]
    assert len(scan.identifiers(scan.parse("MIT OR (" * 50_000 + "ISC" + ")" * 50_000))) == 50_001


def test_report(spark):
    got = scan.report(documents(spark))
    assert got.columns[:6] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert [r[:6] for r in rows(got)] == sorted(((i, *brute(t)) for i, t in TEXTS), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
    assert scan.report(empty(spark)).count() == 0
    assert "doc_id" in scan.scan_documents(documents(spark)).columns
