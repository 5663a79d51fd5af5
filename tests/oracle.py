"""Run registered queries beside their SQL twins."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings parsed_documents extracted_rows audit_issues processing_state batch_manifest eval_items grade_labels".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, other = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert names == other, (names, other)
    odd = [(a, b) for a, b in zip(got, want) if a != b][:4]
    assert len(got) == len(want), (len(got), len(want), odd)
    assert not odd, odd
    return len(got)
