"""Problem 7: every token in one bin, no bin too full, room close to the bound."""

import math
import random
from collections import defaultdict

import pytest

from loomset.llm.packing import TOKENIZER, _encoding, pack, token_sizes


def run(spark, sizes, capacity):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, size long").selectExpr("*", "'x' as bin", "7 as part", "1 as class")
    rows = pack(df, "doc_id", capacity).collect()
    bins, items = defaultdict(int), defaultdict(int)
    for r in rows:
        bins[r.bin] += r.size
        items[r.doc_id] += r.size
        assert r.size > 0
        if sizes[r.doc_id] <= capacity:
            assert r.part == 0 and r.size == sizes[r.doc_id]
    assert len(rows) == len({(r.doc_id, r.part) for r in rows})
    assert items == {i: s for i, s in enumerate(sizes) if s > 0}
    assert max(bins.values(), default=0) <= capacity
    return bins


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    random.seed(seed)
    sizes = [int(random.lognormvariate(5.3, 1)) for _ in range(3000)] + [0, 2048, 2049, 4096, 10_000, 1]
    bins = run(spark, sizes, 2048)
    assert len(bins) <= 1.12 * math.ceil(sum(sizes) / 2048)


def test_edges(spark):
    assert len(run(spark, [], 100)) == 0
    assert len(run(spark, [0, 0], 100)) == 0
    assert len(run(spark, [100] * 5, 100)) == 5
    assert len(run(spark, [50] * 10, 100)) == 5
    assert len(run(spark, [60, 40] * 50, 100)) == 50
    assert len(run(spark, [250], 100)) == 3


def test_sizes(spark):
    rows = [(1, "Read the map."), (2, ""), (3, None), (4, "Größe der Karte " * 20_000), (5, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 as size", "'k' as key")
    got = {r.doc_id: r.size for r in token_sizes(df, "doc_id", "text").collect()}
    encoding = _encoding(TOKENIZER)
    assert got.keys() == {1, 4, 5}
    assert got[1] == len(encoding.encode_ordinary("Read the map."))
    assert got[4] == len(encoding.encode_ordinary(rows[3][1]))
