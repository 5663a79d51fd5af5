"""Problem 3 on small columns with known splits."""

import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomset.operators import packed_values
from loomset.operators.packed_values import split_values

COLUMN = (
    [(n, str(n % 12 + 1), "domain is blank") for n in range(100)]
    + [(n, "Life Skills", "Code order differs from the source, expected 3, found 4") for n in range(100, 140)]
    + [(n, "Stage 5", "topic is not one of A / B / C and was dropped") for n in range(140, 180)]
    + [(n, "K", "row 7 missing from outline") for n in range(180, 220)]
    + [(n, None, "Code order differs from the source, expected 3, found 4, then saw the log there, then saw the hut there") for n in range(220, 240)]
    + [(n, None, "row 5 missing from outline | domain is blank; Code order differs from the source, expected 3, found 4") for n in range(5000, 5040)]
)
CASES = [
    ("6,7", ["6", "7"]),
    ("3, 4 and 5", ["3", "4", "5"]),
    ("9–12", ["9", "10", "11", "12"]),
    ("9 to 11", ["9", "10", "11"]),
    ("9,10–12", ["9", "10", "11", "12"]),
    ("10 11", ["10", "11"]),
    ("K/1/2;", ["K", "1", "2"]),
    ('["8", "9"]', ["8", "9"]),
    ('"Stage 3" ; "Stage 3, extension"', ["Stage 3", "Stage 3, extension"]),
    ("4,, 5,", ["4", "5"]),
    ("1-20000", [str(n) for n in range(1, 20001)]),
    ("7, 5-10005, K", ["7", *map(str, range(5, 10006)), "K"]),
    ("1-4000000000, 6", ["1-4000000000", "6"]),
    ("; ".join(str(n) for n in range(3000)), [str(n) for n in range(3000)]),
    ("5;5", ["5", "5"]),
    ("5;", []),
    ('"5"', []),
    ("12-9", []),
    ("", []),
    ("  ", []),
    (None, []),
]
PROSE = "Pupils in the yard" + "".join(f", then saw the {w} there" for w in "oak elm ash fir yew bay box fig hop ivy pea rye tea nut lime pear plum palm pine reed".split())
ISSUES = [
    ("domain is blank | row 9 missing from outline", ["domain is blank", "row 9 missing from outline"]),
    ("Code order differs from the source, expected 8, found 9 | domain is blank |", ["Code order differs from the source, expected 8, found 9", "domain is blank"]),
    ('"ends in ""and so on"""; domain is blank', ['ends in "and so on"', "domain is blank"]),
    ('"Heading kept: \'Unit 5 | English\'"\nrow 3 missing from outline', ["Heading kept: 'Unit 5 | English'", "row 3 missing from outline"]),
    ("topic is not one of A / B / C and was dropped", []),
    (PROSE + " | domain is blank", [PROSE, "domain is blank"]),
    ("domain is blank; " + PROSE + "; row 9 missing from outline", ["domain is blank", PROSE, "row 9 missing from outline"]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = COLUMN + [(1000 + i, c[0], None) for i, c in enumerate(CASES)] + [(2000 + i, None, c[0]) for i, c in enumerate(ISSUES)]
    df = spark.createDataFrame(rows, "row_id long, grade_number string, review_issues string").withColumn("value", F.lit("clash")).withColumn("pos", F.lit(1))
    got = {}
    for r in split_values(df, "row_id", ["grade_number", "review_issues"]).orderBy("row_id", "field_name", "pos").collect():
        got.setdefault((r.row_id, r.field_name), []).append((r.pos, r.val))
    return got


@pytest.mark.parametrize(("i", "case"), list(enumerate(CASES)))
def test_grades(found, i, case):
    assert found.get((1000 + i, "grade_number"), []) == list(enumerate(case[1], 1))


@pytest.mark.parametrize(("i", "case"), list(enumerate(ISSUES)))
def test_issues(found, i, case):
    assert found.get((2000 + i, "review_issues"), []) == list(enumerate(case[1], 1))


def test_single_values_stay(found):
    assert not [k for k in found if k[0] < 1000]


def test_learning_decides(spark):
    """All gaps start alike; what the commas and the bars of issues are is learned from the column."""
    rows = [(i, t) for i, (_, _, t) in enumerate(COLUMN) if t] + [(2000 + i, t) for i, (t, _) in enumerate(ISSUES)]
    df = spark.createDataFrame(rows, "row_id long, review_issues string")
    at = lambda rounds: {tuple(r) for r in split_values(df, "row_id", ["review_issues"], rounds).collect() if 2000 <= r.row_id < 5000}
    want = {(2000 + i, "review_issues", pos, v) for i, (_, vals) in enumerate(ISSUES) for pos, v in enumerate(vals, 1)}
    assert at(packed_values.ROUNDS) == want


def every_path(n, edges):
    if n == 0:
        yield []
    for i, j, s in edges:
        if j + 1 == n:
            for path in every_path(i, edges):
                yield [*path, (i, j, s)]


def test_running_pieces_against_all_paths(monkeypatch):
    """Long unseen pieces by their running state: the same best score and the same expectations as path by path."""
    random.seed(6)
    monkeypatch.setattr(packed_values, "ORDER", 2)
    monkeypatch.setattr(packed_values, "UNSEEN", math.log(0.2))
    monkeypatch.setattr(packed_values, "UNSEEN_GAP", math.log(0.7))
    for _ in range(40):
        n = random.randint(1, 7)
        gaps = [random.randint(0, 3) for _ in range(n - 1)]
        inside = [random.uniform(0.1, 0.9) for _ in range(packed_values.KINDS)]
        known = [(i, j, random.choice([0.0, random.random()])) for i in range(n) for j in range(i, min(n, i + 2))] + ([(0, n - 1, random.random())] if n > 2 else [])
        cost = lambda i, j: sum(math.log(inside[g]) for g in gaps[i:j]) + (math.log1p(-inside[gaps[j]]) if j < n - 1 else 0.0)
        unseen = lambda i, j: packed_values.UNSEEN + (j - i) * packed_values.UNSEEN_GAP
        edges = [(i, j, max(math.log(p) if p else -math.inf, unseen(i, j)) + cost(i, j)) for i, j, p in known]
        edges += [(i, j, unseen(i, j) + cost(i, j)) for i, j in itertools.combinations(range(n), 2) if j - i >= 2]
        paths = [(sum(s for _, _, s in path), path) for path in every_path(n, edges)]
        scores = packed_values._Scores([k[0] for k in known], [k[1] for k in known], [k[2] for k in known], gaps, inside)
        assert scores.forward(max)[0][-1] == pytest.approx(max(s for s, _ in paths))
        total = sum(math.exp(s) for s, _ in paths)
        assert scores.forward(packed_values._plus)[0][-1] == pytest.approx(math.log(total))
        batch = pd.DataFrame({"field_name": ["f"], "shape_id": [1], "weight": [2.0], "firsts": [[k[0] for k in known]], "lasts": [[k[1] for k in known]], "shares": [[k[2] for k in known]], "pieces": [list(range(len(known)))], "gaps": [gaps], "begins": [list(range(n))], "ends": [list(range(n))]})
        got = {(r.kind, r.name): r.mass for b in packed_values._expected({"f": inside})(iter([batch])) for r in b.itertuples()}
        for g in set(gaps):
            held = sum(math.exp(s) * sum(gaps[i:j].count(g) for i, j, _ in path) for s, path in paths) / total
            split = sum(math.exp(s) * sum(gaps[j] == g for i, j, _ in path if j < n - 1) for s, path in paths) / total
            assert got.get(("inside", g), 0.0) == pytest.approx(2 * held)
            assert got.get(("between", g), 0.0) == pytest.approx(2 * split)
        cuts = next(iter(packed_values._best({"f": inside})(iter([batch]))))["cuts"][0]
        assert max(paths)[0] == pytest.approx(max(s for s, path in paths if [[i, j] for i, j, _ in path] == cuts))


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, grade_number string")
    assert split_values(df, "row_id", ["grade_number"]).count() == 0
