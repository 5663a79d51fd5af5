"""Problem 5 against a plain Python grouping on a small table."""

import random
import re

from loomset.llm.formatting_copies import formatting_copies

SCHEMA = "row_id long, description string, source_document string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as record", "'y' as salt", "1 as copies")
    return {(r.first_row_id, r.row_id, r.copies) for r in formatting_copies(df, "row_id", "description", ["source_document"]).collect()}


def test_cases(spark):
    rows = [
        (1, "Content: Read maps; Process: draw graphs.", "a_b.pdf"),
        (2, "process - draw  graphs | CONTENT - read maps", "A-B.PDF"),
        (3, "Process   draw graphs / Content   read maps", "a b .pdf"),
        (4, "Content: draw graphs; Process: read maps.", "a_b.pdf"),
        (5, "Read maps and graphs", "a"),
        (6, "Read graphs and maps", "a"),
        (7, ">> read MAPS,\nand graphs!", "a"),
        (8, "read maps and graphs", "b"),
        (9, None, "a"), (10, None, "a"), (11, " \t", "a"), (12, "", "a"),
        (13, "same", None), (14, "Same", None), (15, "same", ""),
        (16, "Straße 5", "s"), (17, "STRASSE 5", "s"), (18, "Straße 6", "s"),
        (19, "Content: find\nprocess words; Process: draw.", "c"), (20, "Content: find process words; Process: draw.", "c"),
        (21, "long " * 30000, "l"), (22, "LONG " * 30000, "l"),
    ]
    rows += [(100 + i, f"Content: case {i}; Process: task {i}.", "f") for i in range(10)] + [(200 + i, f"Process: case {i}, Content: task {i}.", "g") for i in range(10)]
    assert run(spark, rows) == {(1, 2, 3), (1, 3, 3), (5, 7, 2), (13, 14, 3), (13, 15, 3), (16, 17, 2), (19, 20, 2), (21, 22, 2)}


def test_empty_and_hot(spark):
    assert run(spark, []) == set()
    rows = [(i, "One record" if i % 2 else f"other {i}", "d") for i in range(1, 400)]
    assert run(spark, rows) == {(1, i, 200) for i in range(3, 400, 2)}


def test_against_plain_grouping(spark):
    random.seed(3)
    rows = []
    for i in range(400):
        words = [random.choice(["map", "graph", "note", "5"]) for _ in range(3)]
        text = "".join(w.upper() + random.choice([" ", "  ", ", ", "\n"]) if random.random() < 0.3 else w + " " for w in words)
        rows.append((i, text, random.choice(["a.pdf", "A PDF", None])))
    groups = {}
    for i, text, source in rows:
        groups.setdefault(tuple(re.sub(r"[\W_]+", "", (x or "").lower()) for x in (text, source)), []).append(i)
    assert run(spark, rows) == {(g[0], i, len(g)) for g in groups.values() for i in g[1:]}
