"""Problem 2: known meanings, and the pigeonhole join against all pairs."""

import random

import pytest

from loomset.llm.canonical_list import canonical_entries, pigeonhole_matches, reference_keys

LABELS = [
    (1, "grade_level", "Elementary School", ["Primary School", "Primary", "Elementary"]),
    (2, "grade_level", "Middle School", ["Junior High School", "Middle Years"]),
    (3, "grade_level", "High School", ["Senior School", "Senior Years"]),
    (4, "display_grade", "Kindergarten", ["Kinder"]),
    (5, "display_grade", "Grade 1", []),
    (6, "display_grade", "Grade 12", None),
    (7, "display_grade", "Year 1", []),
    (8, "display_grade", "Grades 3-5", []),
    (9, "display_grade", "Life Skills", ["Independent Living"]),
]
LEVEL = [
    ("eLEMENTARY sCHOOL", 1), ("School, High", 3), ("H.S.", 3), ("Elementry Sch.", 1), ("Hihg School", 3), ("Night School", 0),
    ("Law School", 0), ("School", 0), ("Middle_School (all)", 2), ("Senoir Years", 3), ("Primary ", 1), ("High School", None),
    ("", None), ("  ", None), (None, None), ("n/a", 0), ("Elem. Sch.", 1), ("MiddleSchool", 2),
]
GRADE = [
    ("grade I", 5), ("1st grade", 5), ("G12", 6), ("Grade 13", 0), ("one, GRADE", 5), ("Yaer 1", 7), ("3 to 5", 8), ("Gr. 3–5", 8),
    ("Grades 3-6", 0), ("Grade A", 0), ("Year", 0), ("kindregarten", 4), ("KG", 4), ("Lief Skills", 9), ("Skills, Life", 9),
    ("independant living", 9), ("Grade 1", None), ("Level 3", 0), ("Grade 01.", 5), ("x" * 50_000, 0),
]
SCHEMA = "label_id int, field_name string, label string, synonyms array<string>"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, SCHEMA)


def test_meanings(spark, labels):
    rows = [(i, v, None) for i, (v, _) in enumerate(LEVEL)] + [(100 + i, None, v) for i, (v, _) in enumerate(GRADE)]
    df = spark.createDataFrame(rows, "row_id long, grade_level string, display_grade string").selectExpr("*", "'x' as value", "1 as salt", "2 as label_id")
    got = {(r.row_id, r.field_name): r.label_id for r in canonical_entries(df, labels, "row_id", ["grade_level", "display_grade"]).collect()}
    want = {(i, "grade_level"): l for i, (_, l) in enumerate(LEVEL) if l is not None}
    want |= {(100 + i, "display_grade"): l for i, (_, l) in enumerate(GRADE) if l is not None}
    assert got == want


def test_empty(spark, labels):
    none = spark.createDataFrame([], "row_id long, grade_level string, display_grade string")
    assert canonical_entries(none, labels, "row_id", ["grade_level", "display_grade"]).count() == 0
    one = spark.createDataFrame([(1, "High Schol", None)], "row_id long, grade_level string, display_grade string")
    got = canonical_entries(one, labels.limit(0), "row_id", ["grade_level", "display_grade"]).collect()
    assert [tuple(r) for r in got] == [(1, "grade_level", 0)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_join_finds_what_all_pairs_find(spark, labels):
    random.seed(5)
    keys = reference_keys(labels)
    entries = [(r.field_name, r.letters, r.numbers, r.label_id) for r in keys.collect() if len(r.letters) >= 4]
    values = set()
    for field, letters, numbers, _ in entries:
        for _ in range(30):
            text = list(letters)
            for _ in range(random.randint(1, 3)):
                at = random.randrange(len(text))
                kind = random.randint(0, 3)
                if kind == 0 and len(text) > 4:
                    del text[at]
                elif kind == 1:
                    text.insert(at, random.choice("aeinx"))
                elif kind == 2:
                    text[at] = random.choice("aeinx")
                elif at + 1 < len(text):
                    text[at], text[at + 1] = text[at + 1], text[at]
            values.add((field, "".join(text), numbers))
    want = {}
    for field, letters, numbers in values:
        near = []
        for f, entry, n, label in entries:
            if f == field and n == numbers:
                d = edits(letters, entry)
                if d == 2 and sorted(letters) == sorted(entry):
                    d = 1
                if d <= 1:
                    near.append((d, label))
        best = {label for d, label in near if d == min(near)[0]}
        if len(best) == 1:
            want[field, letters, numbers] = best.pop()
    df = spark.createDataFrame(sorted(values), "field_name string, letters string, numbers string")
    got = {(r.field_name, r.letters, r.numbers): r.label_id for r in pigeonhole_matches(df, keys).collect()}
    assert len(want) > 100
    assert got == want
