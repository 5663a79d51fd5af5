"""Problem 8 against a search for every run of words."""

import random
import re

import numpy as np

from loomset.llm import leakage
from loomset.llm.leakage import RUN, Queries, leaks

VOCABULARY = [f"w{i}" for i in range(300)] + ["día", "Ärger", "7"]


def words(text):
    return re.findall(r"[^\W_]+", text.lower()) if text else []


def brute(docs, items):
    found = set()
    for doc, text in docs:
        own = words(text)
        runs = {tuple(own[i : i + RUN]) for i in range(len(own) - RUN + 1)}
        for item, passage in items:
            test = words(passage)
            if any(tuple(test[i : i + RUN]) in runs for i in range(len(test) - RUN + 1)):
                found.add((doc, item))
    return found


def test_against_brute_force(spark):
    random.seed(8)
    text = lambda n: [random.choice(VOCABULARY) for _ in range(n)]
    items = [(i, " ".join(text(random.choice([5, 11, 12, 40, 80])))) for i in range(25)]
    docs = []
    for i in range(150):
        own = text(random.choice([0, 3, 30, 400]))
        for _ in range(random.randint(0, 2)):
            test = words(random.choice(items)[1])
            length = random.choice([8, 11, 12, 13, 30])
            begin = random.randint(0, max(0, len(test) - length))
            at = random.randint(0, len(own))
            own[at:at] = test[begin : begin + length]
        docs.append((i, "".join(w.upper() + random.choice([" ", "\n> ", " ** ", ", "]) for w in own)))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (502, docs[0][1]), (503, " ".join(text(20000)) + " " + items[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as passage", "1 as signature")
    tests = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string").selectExpr("*", "2 as doc_id")
    got = {(r.doc_id, r.item_id) for r in leaks(df, tests).collect()}
    want = brute(docs, items)
    assert len(want) > 20
    assert got == want
    assert leaks(df.limit(0), tests).count() == 0
    assert leaks(df, tests.limit(0)).count() == 0


def test_repeats_and_blocks(spark, monkeypatch):
    """Texts that repeat few words, and test items in several passes."""
    random.seed(9)
    few = lambda n: " ".join(random.choice(["so", "la", "ti"]) for _ in range(n))
    items = [(i, few(random.choice([12, 14, 20]))) for i in range(30)] + [(80, "ha " * 12), (81, "ho " * 40)]
    docs = [(i, few(random.choice([12, 60, 300]))) for i in range(40)] + [(90, "ha " * 500), (91, "ho " * 12), (92, "ho " * 11)]
    monkeypatch.setattr(leakage, "QUERY_WORDS", 100)
    got = leaks(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id int, text string"))
    rows = got.collect()
    assert {(int(r.doc_id), r.item_id) for r in rows} == brute(docs, items)
    assert {r.containment for r in rows if r.doc_id == "90"} == {1.0}


def test_bands_are_enough():
    """The window of an item is found by its bands alone wherever it stands in a text of other words."""
    rng = np.random.default_rng(3)
    item = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    queries = Queries([("a", item)])
    missed = 0
    for trial in range(600):
        before, after = (rng.integers(0, 1 << 63, int(rng.integers(0, 40)), dtype=np.uint64) for _ in range(2))
        begin = int(rng.integers(0, 40 - RUN + 1))
        code = np.concatenate([before, item[begin : begin + RUN], after])
        missed += queries.search(code, np.array([0, len(code)])) == []
    assert missed == 0
    assert queries.search(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.array([0, 5000])) == []


def test_short_pieces_that_repeat():
    rng = np.random.default_rng(5)
    for trial in range(300):
        own = rng.choice(rng.integers(0, 1 << 63, 2, dtype=np.uint64), int(rng.integers(RUN, 21)))
        assert [x[:2] for x in Queries([("a", own[:RUN])]).search(own, np.array([0, len(own)]))] == [(0, 0)]


def test_slices_lose_no_piece(monkeypatch):
    rng = np.random.default_rng(4)
    item = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    texts = [np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), item[k : k + RUN]]) for n, k in ((500, 3), (0, 0), (3, 48), (11, 20))] + [np.empty(0, np.uint64)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = Queries([("a", item)]).search(np.concatenate(texts), bounds)
    assert [n for n, _, _ in whole] == [0, 1, 2, 3]
    monkeypatch.setattr(leakage, "SLICE", 7)
    assert Queries([("a", item)]).search(np.concatenate(texts), bounds) == whole
