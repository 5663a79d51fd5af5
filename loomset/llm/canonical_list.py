"""Problem 2: map freely typed values to the entries of a reference list.

SQL expressions only.  Values are reduced to their distinct forms, brought to a
key (letters without spaces, numbers apart), and looked up in three steps:

1. equality with a key of the list (label, synonym, turned order, initials);
2. a partition-based pigeonhole join: every key of the list is cut into
   ``MAX_EDITS + 1`` segments; a value within ``MAX_EDITS`` edits must hold one
   of them unchanged near its place, so values are joined by equality on
   substrings at those places, then verified with ``levenshtein``;
3. an anti-join reports what found no entry, with label 0.

One edit, or two neighbouring letters exchanged, makes a value an entry's
misspelling; numbers must agree exactly.  Two entries at the same distance
leave a value unmatched.

Defined results: null and blank values and exact labels give no row; repeated
rows give a row for each row id; a table without rows gives none; an empty list
leaves every value unmatched.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.session import checkpointed

MAX_EDITS = 2
#: Copies of the dictionary of values, so that a value held by a third of all rows is joined by several tasks.
SALT = 8
#: Keys shorter than this are matched by equality only.
FUZZY_LENGTH = 4

#: Short forms of the words that grade names are made of.
SHORT = {
    "elem": "elementary", "mid": "middle", "hi": "high", "sch": "school", "jr": "junior", "sr": "senior", "sec": "secondary",
    "prim": "primary", "grades": "grade", "gr": "grade", "grs": "grade", "grd": "grade", "g": "grade", "yr": "year", "y": "year",
    "stg": "stage", "fndn": "foundation", "fdn": "foundation", "kg": "kindergarten", "kgn": "kindergarten", "kindy": "kindergarten",
}
#: Number words, ordinals and roman numerals up to twenty.
NUMBERS = {
    **dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), range(1, 21), strict=True)),
    **dict(zip("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split(), range(1, 13), strict=True)),
    **dict(zip("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi".split(), range(1, 17), strict=True)),
}
#: Words that add nothing to a grade name.
FILLERS = ["no", "nr", "number", "level", "all", "full", "day", "to", "through", "thru", "and", "until"]


def blank(column: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(column, r"(?U)\s+", " ")) == "", F.lit(True))


def _tokens(column: Column) -> Column:
    text = F.lower(column)
    text = F.regexp_replace(text, r"(\d+)(st|nd|rd|th)\b", "$1")
    text = F.regexp_replace(text, r"([\p{L}])(\d)", "$1 $2")
    text = F.regexp_replace(text, r"(\d)([\p{L}])", "$1 $2")
    text = F.regexp_replace(text, r"\b0+(\d)", "$1")
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    words = F.create_map(*[F.lit(x) for x in chain.from_iterable((SHORT | {k: str(v) for k, v in NUMBERS.items()}).items())])
    tokens = F.transform(F.split(text, " "), lambda t: F.coalesce(words[t], t))
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(FILLERS))


def _keyed(df: DataFrame, column: str) -> DataFrame:
    """Add ``words`` (array), ``letters`` (joined words) and ``numbers`` of a text column."""
    number = lambda t: t.rlike("^[0-9]+$") | (t == "k")
    df = df.withColumn("tokens", _tokens(F.col(column)))
    # A lone "k" is the name of a year; beside a number it is the end of a range.
    df = df.withColumn("tokens", F.when(F.size("tokens") == 1, F.transform("tokens", lambda t: F.when(t == "k", "kindergarten").otherwise(t))).otherwise(F.col("tokens")))
    df = df.withColumn("words", F.filter("tokens", lambda t: ~number(t)))
    return df.withColumn("letters", F.array_join("words", "")).withColumn("numbers", F.array_join(F.filter("tokens", number), " ")).drop("tokens")


def reference_keys(labels: DataFrame) -> DataFrame:
    """(field_name, letters, numbers, label_id, fuzzy): the keys under which each entry is found."""
    names = labels.select("field_name", "label_id", F.explode(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name")).where(~blank(F.col("name")))
    keyed = _keyed(names, "name")
    size = F.size("words")
    turned = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.array_join(F.concat(F.slice("words", i + 1, size), F.slice("words", F.lit(1), i)), ""))
    initials = F.when((size >= 2) & (F.col("numbers") == ""), F.array(F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")))
    bare = F.when(F.col("numbers").contains(" "), F.array(F.lit("")))
    none = F.array().cast("array<string>")
    exact = keyed.select("field_name", "numbers", "label_id", F.explode(F.concat(F.when(size > 0, turned).otherwise(F.array("letters")), F.coalesce(initials, none), F.coalesce(bare, none))).alias("letters"))
    # A key that stands for several entries stands for none.
    return exact.groupBy("field_name", "letters", "numbers").agg(F.min("label_id").alias("label_id"), F.max("label_id").alias("other")).where("label_id = other").drop("other")


def _segments(length: Column) -> Column:
    """(number, start, size) of the segments of a key of this length, starts from 1."""
    parts = MAX_EDITS + 1
    low = F.floor(length / parts).cast("int")
    long = (length % parts).cast("int")
    each = []
    for i in range(parts):
        before = F.least(F.lit(i), long)
        each.append(F.struct(F.lit(i).alias("number"), (F.lit(i) * low + before + 1).alias("start"), (low + F.when(F.lit(i) < long, 1).otherwise(0)).alias("size")))
    return F.array(*each)


def pigeonhole_matches(values: DataFrame, keys: DataFrame) -> DataFrame:
    """(field_name, letters, numbers, label_id) of keys within one edit or exchange of an entry's key.

    ``values`` has distinct (field_name, letters, numbers).
    """
    both = ["field_name", "numbers", "length", "number", "segment"]
    right = keys.where(F.length("letters") >= FUZZY_LENGTH).withColumnRenamed("letters", "entry").withColumn("length", F.length("entry"))
    right = right.select("*", F.inline(_segments(F.col("length")))).withColumn("segment", F.expr("substring(entry, start, size)")).drop("start", "size")
    left = values.where(F.length("letters") >= FUZZY_LENGTH - 1)
    left = left.select("*", F.explode(F.sequence(F.greatest(F.length("letters") - MAX_EDITS, F.lit(FUZZY_LENGTH)), F.length("letters") + MAX_EDITS)).alias("length"))
    left = left.select("*", F.inline(_segments(F.col("length"))))
    left = left.select("*", F.explode(F.sequence(F.greatest(F.col("start") - MAX_EDITS, F.lit(1)), F.col("start") + MAX_EDITS)).alias("at"))
    left = left.where("at + size - 1 <= length(letters)").withColumn("segment", F.expr("substring(letters, at, size)")).drop("at", "start", "size").distinct()
    pairs = left.join(right, both).select("field_name", "letters", "numbers", "entry", "label_id").distinct()
    pairs = pairs.withColumn("edits", F.levenshtein("letters", "entry", MAX_EDITS)).where("edits >= 0")
    exchanged = (F.length("letters") == F.length("entry")) & (F.array_sort(F.split("letters", "")) == F.array_sort(F.split("entry", "")))
    near = pairs.withColumn("edits", F.when(exchanged & (F.col("edits") == 2), 1).otherwise(F.col("edits"))).where("edits <= 1")
    best = near.groupBy("field_name", "letters", "numbers", "edits").agg(F.min("label_id").alias("label_id"), F.max("label_id").alias("other"))
    best = best.groupBy("field_name", "letters", "numbers").agg(F.min(F.struct("edits", "label_id", "other")).alias("b"))
    return best.where("b.label_id = b.other").select("field_name", "letters", "numbers", "b.label_id")


def map_values(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(field_name, value, label_id) for each distinct (field_name, value); 0 for no entry."""
    # Read by several joins below, so the table is scanned for it once.
    keyed = checkpointed(_keyed(values.distinct(), "value").drop("words"))
    keys = reference_keys(labels)
    forms = keyed.select("field_name", "letters", "numbers").distinct()
    on = ["field_name", "letters", "numbers"]
    exact = forms.join(keys, on)
    fuzzy = pigeonhole_matches(forms.join(exact, on, "left_anti"), keys)
    matched = exact.unionByName(fuzzy)
    unmatched = forms.join(matched, on, "left_anti").withColumn("label_id", F.lit(0).cast(labels.schema["label_id"].dataType))
    return keyed.join(matched.unionByName(unmatched), on).select("field_name", "value", "label_id")


def canonical_entries(rows: DataFrame, labels: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(row_id, field_name, label_id) for every value that isn't null, blank or an exact label."""
    labels = labels.select("label_id", "field_name", "label", "synonyms")
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    typed = rows.select(F.col(row_id).alias("row_id"), F.inline(pairs)).where(~blank(F.col("value")))
    typed = typed.join(labels.select("field_name", F.col("label").alias("value")), ["field_name", "value"], "left_anti")
    mapped = map_values(typed.select("field_name", "value"), labels)
    salted = mapped.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    typed = typed.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALT)).cast("int"))
    return typed.join(salted, ["field_name", "value", "salt"]).select("row_id", "field_name", F.col("label_id").cast("int").alias("label_id"))
