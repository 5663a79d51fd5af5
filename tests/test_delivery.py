"""Delivery operators on small fixtures."""

from pyspark.sql import functions as F

from loomset.operators import delivery, processing
from loomset.operators.numbering import numbered


def test_document_links_and_index(spark):
    rows = [("p", 0, "https://a.example/Unit.PDF?x=1", "Plan"), ("p", 1, "https://a.example/b.docx", "Assessment"), ("p", 2, "https://a.example/c.html", ""), ("p", 3, "https://a.example/d.docx#top", None), ("p", 4, "https://a.example/e.pdf", "Course"), ("q", 0, "https://a.example/support/x.pdf", "")]
    links = spark.createDataFrame(rows, "page string, pos int, url string, label string").fillna("")
    kept = delivery.document_links(links, "page", ["assessment", "support"])
    assert sorted(r.pos for r in kept.collect()) == [0, 3, 4]
    assert [tuple(r) for r in delivery.index_pages(kept, "page").collect()] == [("p", 3, True)]


def test_numbers_in_hot_and_null_groups(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "source string, row_id int").repartition(7)
    got = {(r.source, r.row_id): r.local for r in numbered(df, "source", "row_id", "local", 2).collect()}
    want, seen = {}, {}
    for source, i in rows:
        seen[source] = seen.get(source, 1) + 1
        want[source, i] = seen[source]
    assert got == want
    assert numbered(df.limit(0), "source", "row_id", "local", 2).count() == 0


def test_pending_knows_changed_content(spark):
    state = spark.createDataFrame([("a", "1", "verified", "t1"), ("b", "1", "verified", "t1"), ("c", "1", "failed", "t1"), (None, "1", "verified", "t1")], "path string, fingerprint string, status string, processed_at_utc string").withColumns({"retryable": F.lit(False), "config_signature": F.lit("s"), "errors": F.array().cast("array<string>")})
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "9")], "path string, fingerprint string")
    assert {r.path for r in processing.pending(files, state, "s").collect()} == {"b", "c", "d"}


def test_statuses_and_retries(spark):
    flags = {"extracted": F.col("n") > 5, "manual_review": F.col("n") > 3, "uploaded": F.col("n") > 1}
    assert [r[0] for r in spark.createDataFrame([(9,), (4,), (2,), (0,)], "n int").select(delivery.batch_status(flags)).collect()] == ["extracted", "manual_review", "uploaded", "new"]
    errors = spark.createDataFrame([(["x OPENAI_API_KEY is not configured"],), (["other"],), ([],), (None,)], "e array<string>")
    assert [r[0] for r in errors.select(delivery.retryable(F.col("e"))).collect()] == [True, False, False, False]


def test_lines_put_together(spark):
    spans = [(1, 0, "Ar", 0.0, 10.0, 12.0), (1, 1, "ith", 10.5, 25.0, 12.0), (1, 2, "metic", 25.0, 50.0, 12.0), (1, 3, "now", 60.0, 75.0, 6.0), (1, 4, " then ", 90.0, 120.0, 12.0), (1, 5, "", 0.0, 0.0, 1.0), (2, 0, "  ", 0.0, 10.0, 9.0)]
    df = spark.createDataFrame(spans, "line int, span int, text string, x0 double, x1 double, size double")
    lines = delivery.joined_lines(df, ["line"])
    got = {r.line: (r.text, r.size) for r in lines.collect()}
    assert got == {1: ("Arithmetic now then", 10.8), 2: ("", None)}
    assert [tuple(r) for r in delivery.blocks_of(lines.withColumn("block", F.lit(1)), ["block"], "line").collect()] == [(1, "Arithmetic now then", 10.8)]


def test_texts(spark):
    one = spark.createDataFrame([("x",)], "x string")
    value = lambda c: one.select(c).first()[0]
    assert value(delivery.fenced_json(F.lit('a ```json\n{"k": 1}\n``` b'))) == '{"k": 1}'
    assert value(delivery.fenced_json(F.lit('so {"k": {"m": 2}} it is'))) == '{"k": {"m": 2}}'
    assert value(delivery.fenced_json(F.lit("none"))) == ""
    assert value(delivery.sanitized_query(F.lit("https://a.example/b?Sample_Row=3&y=2#z"), ["sample_row"])) == "https://a.example/b?y=2#z"
    assert value(delivery.expanded_example(F.lit("007"), F.lit(3))) == "9"
    assert value(delivery.expanded_example(F.lit("Unit"), F.lit(2))) == "Unit 2"
    assert value(delivery.name_slug(F.lit("  Été & Co. "))) == "t-co"
    assert value(delivery.safe_name(F.lit("...")) ) == "input"
    assert value(delivery.citation_gaps(F.lit("a"), F.lit(None))) == "missing"
