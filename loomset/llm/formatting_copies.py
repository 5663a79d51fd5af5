"""Problem 5: one record for copies that differ in formatting only.

Dictionary encoding: the distinct values of each column are canonicalised once
and given an integer identifier (the smallest row id that bears the canonical
value); records become small arrays of (field, identifier), sorted, and are
grouped as such.  Text is shuffled once, to find the distinct values; after
that only integers move: the key of a raw or canonical text is a pair of 64-bit
hashes, which for 10 billion values collide with a chance below 1e-18.

A canonical value has lower-case letters and digits only.  In a column of
labelled text ("Name: text") the parts are put in one order.  Which words are
labels is learned from the column: a word is one if a colon or dash follows it at
the beginning of ``LABEL_TEXTS`` texts at least, and of ``LABEL_SHARE`` of those
that it begins.  Labels stay a table of any length: a text that begins with one is
cut into candidate parts, and the first word of each part is joined to the table.

Values that bear a ``HOT`` part of all rows, of which there can't be more than
that many, are joined back to the rows by broadcast, all others by shuffle.

Defined results: rows with a null or blank key text are never copies; a null
and a blank value of another field are the same; exact copies count; an empty
table gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.session import written

LABEL_SHARE, LABEL_TEXTS = 0.2, 2
#: A value of more than one row in so many is joined by broadcast.
HOT = 1000
SALT = 8
#: What may stand before a label: the beginning of the text or the end of a part.
#: A line break alone may also fall within prose, so the label behind it must look like one.
BEFORE_LABEL = r"(^[^\p{L}\p{N}]*|[;|/.•][^\p{L}\p{N}]*|\n[^\p{L}\p{N}]*(?=\p{L}+\s*(?::|\s[-–]|\s\s)))"


def _plain(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.concat(F.lit("+"), text))]


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}]+", "")


def part_labels(values: DataFrame, column: str) -> DataFrame:
    """(word): words that the texts of ``column`` use as names of their parts."""
    opening = F.regexp_extract(_plain(F.col(column)), r"^[^\p{L}\p{N}]*(\p{L}+[ \t]*(?::|[ \t][-–]|–)?)", 1)
    words = values.select(opening.alias("opening")).where("opening != ''")
    words = words.select(F.regexp_extract("opening", r"^\p{L}+", 0).alias("word"), F.col("opening").rlike("[:–-]$").cast("int").alias("named"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("named").alias("named"))
    return counts.where((F.col("named") >= LABEL_TEXTS) & (F.col("named") >= LABEL_SHARE * F.col("n"))).select("word")


def canonical(values: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``values`` (row_id, value, ...) with ``form``: letters and digits in lower case, labelled parts in one order."""
    plain = _plain(F.col("value"))
    if labels is None:
        return values.withColumn("form", _letters(plain))
    opening = F.regexp_extract(plain, r"^[^\p{L}\p{N}]*(\p{L}+)(?![\p{L}\p{N}])", 1)
    opened = values.withColumn("word", opening)
    whole = opened.join(labels, "word", "left_anti").drop("word").withColumn("form", _letters(plain))
    marked = F.regexp_replace(plain, BEFORE_LABEL + r"(\p{L}+)(?![\p{L}\p{N}])", "$1\u0001$2")
    parts = opened.join(labels, "word", "left_semi").select("row_id", F.posexplode(F.split(marked, "\u0001")).alias("at", "part"))
    named = parts.withColumn("word", F.regexp_extract("part", r"^\p{L}+", 0)).join(labels.withColumn("label", F.lit("\u0001")), "word", "left")
    # A part behind no label goes on with the one before it.
    listed = F.array_sort(F.collect_list(F.struct("at", F.concat(F.coalesce("label", F.lit("")), _letters(F.col("part"))).alias("text"))))
    joined = named.groupBy("row_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("all"))
    form = F.array_join(F.array_sort(F.filter(F.split("all", "\u0001"), lambda p: p != "")), "\u0001")
    return whole.unionByName(values.join(joined.select("row_id", form.alias("form")), "row_id"))


def value_identifiers(rows: DataFrame, column: str, labelled: bool) -> DataFrame:
    """(raw1, raw2, id, n): identifier and number of rows of every distinct value of ``column``; rows has ``row_id``."""
    values = rows.groupBy(F.col(column).alias("value")).agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))
    labels = None
    if labelled:
        values = written(values)
        labels = written(part_labels(values, "value"))
    raw, form = _digest(F.col("value")), _digest(F.col("form"))
    coded = canonical(values, labels).select("row_id", "n", raw[0].alias("raw1"), raw[1].alias("raw2"), form[0].alias("form1"), form[1].alias("form2"))
    coded = written(coded)
    return coded.join(coded.groupBy("form1", "form2").agg(F.min("row_id").alias("id")), ["form1", "form2"]).select("raw1", "raw2", "id", "n")


def coded_records(rows: DataFrame, row_id: str, text: str, others: list[str]) -> DataFrame:
    """(row_id, record): the fields of every row as a sorted array of (field, identifier).

    ``text`` is the labelled text that must not be blank, ``others`` the further
    fields that must agree.
    """
    fields = [text, *others]
    filled = rows.where(F.col(text).rlike(r"(?U)\S")).select(F.col(row_id).alias("row_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"field{i}") for i, f in enumerate(fields)])
    keys = [d.alias(f"key{i}{k}") for i in range(len(fields)) for k, d in enumerate(_digest(F.col(f"field{i}")))]
    coded = written(filled.select("row_id", *keys))
    total = coded.count()
    for i in range(len(fields)):
        both = [f"key{i}0", f"key{i}1"]
        ids = written(value_identifiers(filled, f"field{i}", labelled=i == 0)).select(F.col("raw1").alias(both[0]), F.col("raw2").alias(both[1]), F.col("id").alias(f"id{i}"), "n")
        hot, cold = ids.where(F.col("n") * HOT > total).drop("n"), ids.where(F.col("n") * HOT <= total).drop("n")
        often = coded.join(F.broadcast(hot), both)
        coded = often.unionByName(coded.join(F.broadcast(hot.select(*both)), both, "left_anti").join(cold, both))
    record = F.array_sort(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"id{i}").alias("id")) for i in range(len(fields))]))
    return coded.select("row_id", record.alias("record"))


def records(rows: DataFrame, row_id: str, text: str, others: list[str]) -> DataFrame:
    """(first_row_id, copies): every record once, by its smallest row, with the number of its rows."""
    return coded_records(rows, row_id, text, others).groupBy("record").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies")).drop("record")


def formatting_copies(rows: DataFrame, row_id: str, text: str, others: list[str]) -> DataFrame:
    """(first_row_id, row_id, copies) for every row that repeats another record's fields."""
    coded = written(coded_records(rows, row_id, text, others))
    groups = coded.groupBy("record").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies")).where("copies > 1")
    salted = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    coded = coded.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALT)).cast("int"))
    return coded.join(salted, ["record", "salt"]).where("row_id != first_row_id").select("first_row_id", "row_id", "copies")
