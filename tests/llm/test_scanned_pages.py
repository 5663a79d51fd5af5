"""Problem 1: hand-made scanned pages whose noise is known."""

import pytest

from loomset.llm.scanned_pages import CONFUSIONS, corrections, page_noise, repaired_texts

SCHEMA = "document_id string, source_type string, markdown string"
CLEAN = "The learners compare several weather records in a modern corner. A short- and long-term plan with hands-on work. Some learners explain records.\n"


def scan(org, style, extra=""):
    page = lambda n: style.format(n)
    return (
        f"# {org} Health\n\nThe 1earners compare several weath-\ner records. Some leamers use hands-\non work with a short-\nand long-term plan.\n{page(1)}\n\n{org} Health Framework   Draft 3\n\n"
        f"Sample counts:\n12\n7\n\nSome learners exp-\n{page(2)}\n{org} Health Framework   Draft 3\nlain weather records.\n{extra}{page(3)}\n{org} Health Framework   Draft 3\n"
    )


@pytest.fixture(scope="module")
def found(spark):
    docs = [(f"c{i}", "docx", CLEAN * 5) for i in range(4)]
    docs += [("s1", "pdf", scan("Oakby", "- {} -")), ("s2", "pdf", scan("Elmton", "Page {} of 3")), ("s3", "pdf", scan("Ashford", "{}")), ("s4", "pdf", scan("Birchham", "[{}]"))]
    docs += [("s5", "pdf", None), ("s6", "pdf", ""), ("s7", "pdf", "one line"), ("s8", None, "x"), ("s1", "pdf", scan("Oakby", "- {} -"))]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' as line", "1 as line_no", "true as scanned")
    got = {}
    for r in page_noise(df).collect():
        got.setdefault(r.document_id, set()).add((r.line_no, r.kind, r.repaired))
    return got


@pytest.mark.parametrize("doc", ["s1", "s2", "s3", "s4"])
def test_pages(found, doc):
    want = {(n, "page_number", "") for n in (7, 16, 19)} | {(n, "header", "") for n in (9, 17, 20)}
    want |= {(3, "misread", "learners"), (4, "misread", "learners"), (3, "hyphen", "weather"), (4, "hyphen", "hands-on"), (15, "hyphen", "explain")}
    assert found[doc] == want


def test_nothing_else(found):
    assert set(found) == {"s1", "s2", "s3", "s4"}


def test_empty(spark):
    assert page_noise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_corrections_against_all_pairs(spark):
    right = {"learners": 500, "corner": 300, "modern": 200, "weather": 900, "discuss": 400, "inline": 90}
    odd = {"1earners": 3, "leamers": 5, "comer": 4, "modem": 2, "wcather": 9, "cliscuss": 1, "mline": 2, "unrelated": 1, "weafher": 400}
    rows = [(w, n, n) for w, n in right.items()] + [(w, 0, n) for w, n in odd.items()]
    want = {}
    for wrong, n in odd.items():
        near = [(2 * total, word) for word, total in right.items() for a, b in CONFUSIONS for i in range(len(word)) if word[i:].startswith(a) and word[:i] + b + word[i + len(a) :] == wrong and 2 * total >= 4 * n]
        if near:
            want[wrong] = max(near)[1]
    got = {r.word: r.repaired for r in corrections(spark.createDataFrame(rows, "word string, clean long, scans long")).collect()}
    assert got == want
    assert len(want) >= 7


def test_repaired(spark):
    docs = [(f"c{i}", "docx", CLEAN * 5) for i in range(4)] + [(f"s{i}", "pdf", scan(org, "- {} -")) for i, org in enumerate(("Oakby", "Elmton", "Ashford"))]
    got = {r.document_id: r.text for r in repaired_texts(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got["s0"] == (
        "# Oakby Health\n\nThe learners compare several weather records. Some learners use hands-on work with a short- and long-term plan.\n\n"
        "Sample counts:\n12\n7\n\nSome learners explain weather records."
    )
