"""Problem 6 against Unicode's own composition and small cases."""

import random
import unicodedata

import pyarrow as pa
import pytest

from loomset.llm.lookalike import consistent, consistent_text, inconsistent_records


def form(text):
    return consistent(pa.array([text], pa.string()))[0].as_py()


@pytest.mark.parametrize(
    ("odd", "plain"),
    [
        ("ｓｃｏｍｐａｒｅ weath﻿er", "scompare weather"),
        ("Russian word «мир».", "Russian word «мир»."),
        ("Greek word «λόγος»", "Greek word «λόγος»"),
        ("the angle α.", "the angle α."),
        ("νerify", "verify"),
        ("Ρ​réνοir", "Prévoir"),
        ("élèves", "élèves"),
        ("x² CO₂ ½ a ≤ b ♯ Ω π 水", "x² CO₂ ½ a ≤ b ♯ Ω π 水"),
        ("ﬁndings", "findings"),
        ("а bit", "a bit"),
        ("", ""),
        ("​", ""),
        ("tab\tline\n", "tab\tline\n"),
    ],
)
def test_cases(odd, plain):
    assert form(odd) == plain


def test_marks_follow_unicode():
    random.seed(1)
    letters = "aeioqd ̧̣́̀̈̇zñế"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 12))) for _ in range(5000)]
    assert consistent(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFC", x) for x in texts]


def test_nulls_empty_and_long():
    texts = [None, "", "é" * 700_000, "é" * 700_000, "а" * 3]
    assert consistent(pa.array(texts)).to_pylist() == [None, "", "é" * 700_000, "é" * 700_000, "aaa"]
    assert consistent(pa.array([], pa.string())).to_pylist() == []


def test_idempotent():
    texts = ["ｓｃｏｍｐａｒｅ", "νerify", "ẹ́", "мир", "fi ﬁ"]
    once = consistent(pa.array(texts))
    assert consistent(once).to_pylist() == once.to_pylist()


def test_frame(spark):
    rows = [(1, "plain"), (2, "wіth"), (3, None), (4, ""), (5, "wіth")]
    df = spark.createDataFrame(rows, "row_id long, description string").withColumn("changed", __import__("pyspark").sql.functions.lit("mine"))
    got = {r.row_id: (r.consistent, r.changed) for r in consistent_text(df, "description").collect()}
    assert got == {1: ("plain", False), 2: ("with", True), 3: (None, False), 4: ("", False), 5: ("with", True)}
    found = inconsistent_records(df, "description", "description", "row_id").collect()
    assert sorted(r.record_id for r in found) == ["2", "5"]
    assert inconsistent_records(df.limit(0), "description", "description", "row_id").count() == 0
