"""Collision resolution against the plain fold over all rows."""

import random
import re

from loomset.operators.codes import resolved_collisions


def candidates(domain, topic):
    out = []
    for value in (domain, topic):
        for part in [p.strip() for p in (value or "").split("|") if p.strip()]:
            tokens = re.findall("[A-Z0-9]+", part.upper())
            for source in ("".join(t[0] for t in tokens), "".join(tokens)):
                out += [source[:n] for n in (2, 3, 4) if len(source) >= n]
    return list(dict.fromkeys(out))


def fold(rows):
    taken, out = set(), {}
    for n, code, domain, topic in sorted(rows):
        code = (code or "").strip()
        if not code:
            continue
        new = code if code not in taken else next((f"{p}.{code}" for p in candidates(domain, topic) if f"{p}.{code}" not in taken), code)
        taken.add(new)
        out[n] = new
    return out


def test_against_full_fold(spark):
    random.seed(4)
    words = ["Data Analysis", "Number", "Forces | Motion", "Fo", "", None, "Local maps | Number"]
    codes = ["1.1", "X.1", "DA.X.1", "NU.1.1", "FO.1.1", "AB.NU.1.1", "DA.DA.X.1", "", None, " 1.1 ", "Q"]
    for _ in range(3):
        rows = [(n, random.choice(codes), random.choice(words), random.choice(words)) for n in range(300)]
        df = spark.createDataFrame(rows, "row_id long, code string, domain string, topic string").selectExpr("*", "1 as n", "'x' as component")
        got = {r.n: r.resolved for r in resolved_collisions(df, "row_id", "code", ["domain", "topic"]).collect()}
        assert got == fold(rows)


def test_hot_code_and_empty(spark):
    rows = [(n, "1.1", "Data", None) for n in range(500)]
    df = spark.createDataFrame(rows, "row_id long, code string, domain string, topic string")
    assert {r.n: r.resolved for r in resolved_collisions(df, "row_id", "code", ["domain", "topic"]).collect()} == fold(rows)
    assert resolved_collisions(df.limit(0), "row_id", "code", ["domain", "topic"]).count() == 0
