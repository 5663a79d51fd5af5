"""Sources, sinks, the fix loop and the file watch on small folders."""

import io
import os
import time
import zipfile

from pyspark.sql import functions as F

from loomset.operators.documents import chunks, halves, region
from loomset.operators.fix_loop import fix_loop
from loomset.operators.schema_inference import inferred_schema
from loomset.sources.files import csv_rows, discovered, docx_markdown, html_links, parsed_docx, referenced_urls, write_csv
from loomset.streaming.watch import watch

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_docx():
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Plan", "Heading1") + p("Read.") + p("one", "ListBullet") + f"<w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr></w:tbl>" + p("")
    assert docx_markdown(docx(body)) == "# Plan\n\nRead.\n\n- one\n\n| A | B |\n| --- | --- |\n|  |  |"
    assert docx_markdown(b"no archive") is None


def test_discovery(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(p("Text")))
    (tmp_path / "b.url").write_text("[InternetShortcut]\nURL=https://x.example/p\n")
    (tmp_path / "c.txt").write_text("no link")
    (tmp_path / "d.webloc").write_text("<plist><string>https://y.example</string></plist>")
    (tmp_path / "e.png").write_bytes(b"x")
    files = discovered(spark, str(tmp_path))
    assert sorted((r.name, r.kind) for r in files.select("name", "kind").collect()) == [("a.docx", "docx"), ("b.url", "website"), ("d.webloc", "website")]
    assert sorted(r.url for r in referenced_urls(files).collect()) == ["https://x.example/p", "https://y.example"]
    assert [(r.document_id, r.markdown) for r in parsed_docx(files).collect()] == [("a", "Text")]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", 'say "hi", twice', ""), ("b", "two\nlines", " padded "), ("", "", "x")]
    df = spark.createDataFrame(rows, "k string, v string, w string")
    write_csv(df.coalesce(1), str(tmp_path / "out"))
    got = csv_rows(spark, str(tmp_path / "out"))
    assert sorted((r.k, r.v, r.w) for r in got.collect()) == sorted(rows)
    assert [r.line_no for r in got.orderBy("line_no").collect()] == [2, 3, 4]


def test_csv_lines_of_several_files(spark, tmp_path):
    for name, n in (("a", 3), ("b", 5)):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f'{name}{i},"x\n{i}"\n' for i in range(n)))
    got = {r.k: r.line_no for r in csv_rows(spark, str(tmp_path)).collect()}
    assert got == {f"{name}{i}": i + 2 for name, n in (("a", 3), ("b", 5)) for i in range(n)}


def test_html_links(spark):
    html = '<p><a class="x" href="/a.pdf">The <b>plan</b></a> <A HREF=\'https://b.example\'>B\n b</A><a name="n">none</a></p>'
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(html_links(F.col("h")).alias("l")).collect()
    assert [tuple(x) for x in got[0].l] == [("/a.pdf", "The plan"), ("https://b.example", "B b")]


def test_chunks_against_fold(spark):
    text = "".join(f"line {i} " + "x" * (i * 7 % 90) + "\n" for i in range(60)) + "tail"

    def fold(value, limit):
        if len(value) <= limit:
            return [value]
        out, now = [], ""
        for line in value.splitlines(keepends=True):
            if now and len(now) + len(line) > limit:
                out.append(now)
                now = ""
            now += line
        return out + ([now] if now else [])

    for limit in (10, 80, 500, 100_000):
        got = spark.createDataFrame([(text,)], "t string").select(chunks(F.col("t"), limit).alias("c")).first().c
        assert got == fold(text, limit)


def test_halves_and_region(spark):
    text = "# A\n" + "x\n" * 3000 + "# B\n" + "y\n" * 2000
    df = spark.createDataFrame([(text, "# A", "# B", ["nothing"], "medium")], "t string, s string, e string, k array<string>, c string")
    h = df.select(halves(F.col("t")).alias("h")).first().h
    assert "".join(h) == text and h[0].endswith("\n")
    r = df.select(region(F.col("t"), F.col("s"), F.col("e"), F.col("k"), F.col("c")).alias("r")).first().r
    assert r == "# A\n" + "x\n" * 3000
    skipped = df.select(region(F.col("t"), F.col("s"), F.lit(""), F.array(F.lit("# A")), F.lit("high")).alias("r")).first().r
    assert skipped == "# B\n" + "y\n" * 2000
    assert df.select(region(F.col("t"), F.lit("# Z"), F.col("e"), F.col("k"), F.col("c")).alias("r")).first().r is None
    assert df.select(region(F.col("t"), F.col("s"), F.col("e"), F.col("k"), F.lit("low")).alias("r")).first().r is None


def test_inferred_schema(spark):
    rows = [(1, "INV-1", "7", "1.5", "yes", ""), (2, " ", "8", "2e3", "No", None)]
    df = spark.createDataFrame(rows, "id int, `Invoice No` string, `n` string, `Amount ()` string, `2nd` string, `N` string")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        schema = inferred_schema(df, ["Invoice No", "n", "Amount ()", "2nd", "N"], "id")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [("invoice_no", "string"), ("n", "bigint"), ("amount", "double"), ("field_2nd", "boolean"), ("n_2", "string")]


def test_fix_loop(spark):
    df = spark.createDataFrame([(i, i) for i in range(6)], "id long, v long")
    check = lambda d: d.withColumn("issues", F.when(F.col("v") < 3, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>")))
    raised = lambda d: d.withColumn("v", F.col("v") + 1)
    got = {r.id: (r.v, r.review_status, r.passes) for r in fix_loop(df, [raised, raised], check).collect()}
    assert got == {0: (2, "NEEDS_REVIEW", 2), 1: (3, "", 2), 2: (3, "", 1), 3: (4, "", 1), 4: (5, "", 1), 5: (6, "", 1)}


def test_watch_processes_each_content_once(spark, tmp_path):
    inbox, state, check = (str(tmp_path / n) for n in ("inbox", "state", "checkpoint"))
    os.makedirs(inbox)
    runs = []

    def process(df):
        rows = df.select("path").collect()
        runs.append(sorted(os.path.basename(r.path) for r in rows))
        return df.select("path", F.when(F.col("path").endswith("bad.txt"), "pending_retry").otherwise("verified").alias("status"), F.array().cast("array<string>").alias("errors"))

    def turn(signature="one", fresh=""):
        watch(spark, inbox, state, check + fresh, process, signature).awaitTermination(120)

    (tmp_path / "inbox" / "a.txt").write_text("one")
    (tmp_path / "inbox" / "bad.txt").write_text("two")
    turn()
    turn(fresh="2")  # another stream over the same state: nothing is due
    (tmp_path / "inbox" / "a.txt").write_text("changed")
    turn(fresh="3")
    turn("other", fresh="4")  # a new configuration: the retry is due
    assert [r for r in runs if r] == [["a.txt", "bad.txt"], ["a.txt"], ["bad.txt"]]


def test_watch_polls_until_stopped(spark, tmp_path):
    inbox, state = str(tmp_path / "inbox"), str(tmp_path / "state")
    os.makedirs(inbox)
    done = lambda df: df.select("path", F.lit("verified").alias("status"), F.array().cast("array<string>").alias("errors"))
    query = watch(spark, inbox, state, str(tmp_path / "checkpoint"), done, every="1 second")
    try:
        for name in ("a.txt", "b.txt"):  # the second comes while the stream runs
            (tmp_path / "inbox" / name).write_text(name)
            deadline = time.time() + 60
            while time.time() < deadline and not (os.path.isdir(state) and spark.read.parquet(state).where(F.col("path").endswith(name)).count()):
                time.sleep(1)
            assert spark.read.parquet(state).where(F.col("path").endswith(name)).count() == 1
        assert query.isActive
    finally:
        query.stop()
