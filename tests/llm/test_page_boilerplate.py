"""Problem 4: hand-made sites whose bodies are known, and the alignment against plain dynamic programming."""

import random

import pytest

from loomset.llm.page_boilerplate import boilerplate_lines, common_lines, main_bodies, page_lines, shared_lines

SCHEMA = "document_id string, source_type string, markdown string, metadata map<string,string>"
TOPICS = ["Maps", "Graphs", "Poems", "Songs", "Maths games", "Rivers", "Clocks", "Plants"]


def page(site, i):
    topic = TOPICS[i % len(TOPICS)]
    top = [f"{site.title()} Schools Board", f"[Home](https://www.{site}-x1.example/{i}/home)[News](https://www.{site}-x1.example/{i}/news)", "", f"Home › Overview › {topic}", ""]
    body = [f"# {topic}", "", "## Overview", "", f"Learners draw {topic.lower()} number {i} with a partner at home.", "", f"* {TOPICS[(i + 3) % 8]}", f"- They compare {topic.lower()} in week {i}.", "", "| Code | Text |", "| --- | --- |", f"| A{i} | row |", ""]
    box = ["## Latest updates", f"- {TOPICS[(i + 1) % 8]}", f"- {TOPICS[(i + 2) % 8]}", ""] if i % 3 == 0 else []
    share = ["Share this page", ""] if i % 2 == 0 else []
    foot = [f"© 20{10 + i % 9} {site.title()} Schools Board. All rights reserved.", "Back to top"]
    parts = [(top, True), (body, False), (box, True), (share, True), (foot, True)]
    lines, gone = [], set()
    for part, noise in parts:
        for line in part:
            lines.append(line)
            if noise and line:
                gone.add(len(lines))
    return "\n".join(lines), gone


@pytest.fixture(scope="module")
def site(spark):
    rows, want = [], {}
    for s in ("oakby", "elmton", "ashford", "birchham"):
        for i in range(9):
            text, gone = page(s, i)
            rows.append((f"{s}_{i}", "website", text, {"url": f"https://www.{s}-x1.example/curriculum/{i}"} if i != 4 else None))
            want[f"{s}_{i}"] = gone
    rows += [("d1", "docx", "# Plan\n\n## Overview\n\nLearners draw maps.", None), ("w0", "website", None, None), ("w1", "website", "", None), rows[0]]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as core", "1 as block", "'y' as host"), want


def test_lines(site):
    df, want = site
    got = {k: set() for k in want}
    for r in boilerplate_lines(df).collect():
        got[r.document_id].add(r.line_no)
    assert got == want


def test_bodies(site):
    df, _ = site
    bodies = {r.document_id: r.body for r in main_bodies(df).collect()}
    assert bodies["oakby_0"].startswith("# Maps\n\n## Overview\n\nLearners draw maps number 0")
    assert bodies["oakby_0"].endswith("| A0 | row |")


def found(df):
    got = {}
    for r in boilerplate_lines(df).collect():
        got.setdefault(r.document_id, set()).add(r.line_no)
    return got


def small_site(s, n):
    rows, want = [], {}
    for i in range(n):
        lines = [f"{s.title()} Learning Trust", "", f"# {TOPICS[i]}", "", f"Learners draw {TOPICS[i].lower()} of {s} at home.", "", f"Call the {s} desk"]
        rows.append((f"{s}_{i}", "website", "\n".join(lines), {"url": f"https://{s}.example/units/{i}"}))
        want[f"{s}_{i}"] = {1, 7}
    return rows, want


@pytest.mark.parametrize("n", [2, 3])
def test_small_hosts(spark, n):
    rows, want = small_site("oakby", n)
    assert found(spark.createDataFrame(rows, SCHEMA)) == want


def test_copies_of_a_page(spark):
    rows, _ = small_site("oakby", 1)
    rows.append(("copy", *rows[0][1:3], {"url": "https://oakby.example/units/9"}))
    assert found(spark.createDataFrame(rows, SCHEMA)) == {}


def test_ranges(spark):
    """Every page in a task of its own or all in one: the same comparisons."""
    rows, want = small_site("elmton", 6)
    df = spark.createDataFrame(rows, SCHEMA)
    shuffle, adaptive = "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"
    before = {k: spark.conf.get(k) for k in (shuffle, adaptive)}
    try:
        spark.conf.set(adaptive, "false")
        counts = []
        for n in (1, 3, 12):
            spark.conf.set(shuffle, str(n))
            assert found(df) == want
            local, wide = shared_lines(page_lines(df))
            counts.append(({tuple(r) for r in local.collect()}, {tuple(r) for r in wide.collect()}))
        assert counts[0] == counts[1] == counts[2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_any_partitioning(site, spark):
    """The whole result on 1, 8 and 60 partitions."""
    df, want = site
    shuffle, adaptive = "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"
    before = {k: spark.conf.get(k) for k in (shuffle, adaptive)}
    try:
        spark.conf.set(adaptive, "false")
        for n in (1, 8, 60):
            spark.conf.set(shuffle, str(n))
            got = found(df.repartition(n))
            assert got == {k: v for k, v in want.items() if v}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_entries_and_wrapped_prose(spark):
    """Entries of a menu may be long; prose that goes on over lines stays."""
    rows = []
    for i in range(6):
        menu = [f"Help for the families of {TOPICS[i].lower()} " + "and of all the schools that we know " * 4, "All news"]
        prose = [f"Learners draw {TOPICS[i].lower()} with a partner", f"at home and talk about {TOPICS[i - 1].lower()} they saw", f"on {TOPICS[i - 2].lower()} day."]
        rows.append((f"oakby_{i}", "website", "\n".join([*menu, "", f"# {TOPICS[i]}", "", *prose]), {"url": f"https://oakby.example/units/{i}"}))
    rows.append((rows[0][0], "website", rows[0][2] + "\nAll news", rows[0][3]))
    assert found(spark.createDataFrame(rows, SCHEMA)) == {f"oakby_{i}": {1, 2} for i in range(6)}


def test_empty(spark):
    assert boilerplate_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_alignment_is_longest():
    random.seed(2)
    for _ in range(300):
        a = [random.choice("abcdef") for _ in range(random.randint(0, 12))]
        b = [random.choice("abcdef") for _ in range(random.randint(0, 12))]
        a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(common_lines(a, b)) == best[-1][-1]
