"""Problem 9: template residue, filler and error pages among the documents.

The address slug, the title and the body of every document are compared.  A
*bare* document says little (at most ``LOW_SENTENCES`` different sentences) and
its body shares no term with its slug, its title or its subject.  What servers
send in place of content is bare time and again, under many hosts; sentences of
real documents aren't.  So every sentence is reduced to a template (hosts and
numbers masked), and its evidence is counted over all documents:

* *hosts*: it stands in ``RESPONSE_DOCS`` documents of ``RESPONSE_HOSTS`` hosts;
* *bareness*: ``RESPONSE_SHARE`` of its documents are bare;
* *terms*: so are, on average, ``RESPONSE_TERMS`` of the sentences that hold one of its terms.

Shares don't change with the size of the corpus, and no list of sentences is
needed.  A template that passes marks every document that holds it, also a long
one with content around it.

Filler is text without information.  It is found by form: a sentence repeated
``RUNS`` times on end, a sentence that repeats its few words.  And by its
vocabulary: dummy words come in sentences that hold no common word of the
corpus, almost nowhere else, and each of them time and again; a rare language
has sentences without common words too, but most of its words are rare there.

*Detectors* find unfilled placeholders in the usual template notations.

Defined results: null and empty texts are no cases; repeated rows of an id give
it once; a missing source or subject is no term to match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.session import written

#: What an unfilled field of a curriculum template is called.
FIELD = r"(?:author|due date|grade band|outcome ?\d*|school(?: name)?|strand|subject|unit(?: title)?|title|name|date|topic|teacher|class|course|level|domain|standard)(?: \d+)?"
#: Placeholder notations, each with a sign that a text with one holds.
PLACEHOLDERS = [
    ("{{", r"\{\{\s*[A-Za-z_][\w.]*(?:\s*\|[^{}\n]*)?\s*\}\}"),
    ("${", r"\$\{[A-Za-z_][\w.]*\}"),
    ("<%", r"<%=?\s*[A-Za-z_][\w.]*\s*%>"),
    ("[[", r"\[\[\s*[A-Za-z_]\w*\s*\]\]"),
    ("%", r"%[A-Z][A-Z0-9_]{2,}%"),
    ("#", r"(?:^|[^#])#[A-Z][A-Z0-9_]{2,}#"),
    ("__", r"\b__[A-Z][A-Z0-9_]*__"),
    ("{", r"(?:^|[^\\\w}$])\{[a-z]\w{2,}\}"),
    ("<", rf"<(?i:{FIELD})>"),
    ("«", rf"«\s?(?i:{FIELD})\s?»"),
    ("[", r"\[(?:INSERT|ADD|ENTER) [^\]\n]+\]"),
    ("[", rf"\[(?i:your|insert|add|enter) (?i:{FIELD})\]"),
    ("(", rf"\((?i:add|insert|enter|your) (?i:{FIELD})\)"),
    ("TODO:", r"\bTODO:\s*\p{L}"),
    ("XXXX", r"\bX{4,}\b"),
    ("laceholder text", r"\b[Pp]laceholder text for\b"),
    ("orem ipsum", r"\b[Ll]orem ipsum\b"),
]

#: A bare document has at most this many different sentences.
LOW_SENTENCES = 4
#: A response repeats in this many documents and hosts at least.
RESPONSE_DOCS, RESPONSE_HOSTS = 3, 3
#: Of a response's documents one in so many is bare; of the sentences with one of its terms, on average.
RESPONSE_SHARE, RESPONSE_TERMS = 5, 0.1
#: Equal sentences on end; words of a sentence that repeats them.
RUNS, RUN_WORDS = 3, 4
#: A common word stands in one of so many sentences; their number is bounded by that times the words of a sentence.
COMMON_SHARE = 100
#: Of a dummy word's sentences this share has no common word, and it stands in one of so many of those.
DUMMY_SHARE, DUMMY_OFTEN = 0.8, 100
#: Share of dummy words in a sentence of ``DUMMY_WORDS`` words or more.
DUMMY_PART, DUMMY_WORDS = 0.8, 4


def detector(text: Column) -> Column:
    """True where an unfilled placeholder stands anywhere in the text."""
    return F.coalesce(reduce(Column.__or__, [text.contains(sign) & text.rlike(pattern) for sign, pattern in PLACEHOLDERS]), F.lit(False))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != "")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 4))


def _lines(text: Column) -> Column:
    """Sentences and lines in lower case, blanks between words made one."""
    ended = F.regexp_replace(F.lower(text), r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(ended, r"\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s.rlike(r"\p{L}"))


def _masked(text: Column) -> Column:
    # Possessive throughout: a word is tried once as a host and once as a number.
    return F.regexp_replace(text, r"(?<![\w-])[\w-]++(?:\.[\w-]++)++|\b[a-f]*+[0-9]++[0-9a-f]*+\b", "#")


def _worded(sentence: Column) -> Column:
    return sentence.rlike(r"\p{L}{4}.*?\P{L}.*?\p{L}{4}")


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, host, bare, direct, template): a row for each distinct sentence of a document.

    ``direct`` is true of a document with a placeholder or a run of equal sentences.
    """
    slug = F.filter(F.split(F.lower(F.coalesce("source", F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)
    title = _terms(F.regexp_extract("text", r"^\s*#+\s*([^\n]*)", 1))
    named = F.array_union(slug, _terms(F.coalesce("subject", F.lit(""))))
    body = _terms(F.regexp_replace("text", r"^\s*#+[^\n]*", ""))
    few = F.size(F.filter("templates", _worded)) <= LOW_SENTENCES
    # Terms are only taken from documents that say little.
    bare = F.when(few, ~F.arrays_overlap(body, F.array_union(named, title)) & ~F.arrays_overlap(title, named)).otherwise(F.lit(False))
    following = F.arrays_zip("lines", *[F.slice("lines", F.lit(k + 1), F.size("lines")).alias(f"next{k}") for k in range(1, RUNS)])
    run = F.exists(following, lambda x: reduce(Column.__and__, [x["lines"].eqNullSafe(x[f"next{k}"]) for k in range(1, RUNS)]))
    work = documents.where(F.col("text") != "").select("doc_id", "text", "source", "subject").withColumn("lines", _lines(F.col("text")))
    work = work.withColumn("templates", F.array_distinct(F.transform("lines", _masked)))
    # Judged once a document, before it becomes a row for each sentence.
    judged = work.select("doc_id", F.xxhash64(F.coalesce("source", F.lit(""))).alias("host"), bare.alias("bare"), (detector(F.col("text")) | run).alias("direct"), "templates")
    return judged.select("doc_id", "host", "bare", "direct", F.explode_outer("templates").alias("template"))


def response_templates(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(template) of the sentences that servers send in place of content."""
    by_host = parts.groupBy(F.xxhash64("template").alias("code"), "host").agg(F.count("*").alias("docs"), F.sum(F.col("bare").cast("long")).alias("bare"))
    counted = by_host.groupBy("code").agg(F.sum("docs").alias("docs"), F.count("*").alias("hosts"), F.sum("bare").alias("bare"))
    likely = counted.where((F.col("docs") >= RESPONSE_DOCS) & (F.col("hosts") >= RESPONSE_HOSTS) & (F.col("bare") * RESPONSE_SHARE >= F.col("docs"))).select("code")
    texts = parts.withColumn("code", F.xxhash64("template")).join(likely, "code", "left_semi").select("template").distinct().where(_worded(F.col("template")))
    uses = texts.select("template", F.explode(_terms(F.col("template"))).alias("word"))
    shares = uses.join(vocabulary.select("word", (F.col("bare") / F.col("n")).alias("share")), "word").groupBy("template").agg(F.avg("share").alias("share"))
    return shares.where(F.col("share") >= RESPONSE_TERMS).select("template")


def vocabulary_of(parts: DataFrame) -> DataFrame:
    """(word, n, bare): in how many sentences each word stands, and in how many of bare documents."""
    listed = parts.select("bare", F.explode(F.array_distinct(_words(F.col("template")))).alias("word"))
    return listed.groupBy("word").agg(F.count("*").alias("n"), F.sum(F.col("bare").cast("long")).alias("bare"))


def filler(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id) of documents with a sentence of repeated or of dummy words."""
    total = parts.count()
    common = [r.word for r in vocabulary.where(F.col("n") * COMMON_SHARE >= total).select("word").collect()]
    words = parts.select("doc_id", "template", _words(F.col("template")).alias("words")).where(F.size("words") >= DUMMY_WORDS)
    repeats = (F.size("words") >= RUN_WORDS) & (F.size(F.array_distinct("words")) * 2 <= F.size("words"))
    strange = ~F.exists("words", lambda w: w.isin(common)) if common else F.lit(False)
    odd = written(words.where(strange | repeats).withColumns({"strange": strange, "repeats": repeats}))
    alien = odd.where("strange")
    often = alien.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("alone"))
    dummy = often.where(F.col("alone") * DUMMY_OFTEN >= alien.count()).join(vocabulary, "word").where((F.col("alone") >= DUMMY_SHARE * F.col("n")) & (F.col("n") >= RESPONSE_DOCS))
    parts_of = alien.select("doc_id", "template", F.size("words").alias("size"), F.explode("words").alias("word")).join(dummy.select("word"), "word")
    made = parts_of.groupBy("doc_id", "template", "size").agg(F.count("*").alias("dummies")).where(F.col("dummies") >= DUMMY_PART * F.col("size"))
    return odd.where("repeats").select("doc_id").unionByName(made.select("doc_id"))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, by_detector, by_response, by_filler) of the documents to exclude."""
    every = written(sentences(documents))
    parts = every.where("template is not null").drop("direct")
    vocabulary = written(vocabulary_of(parts))
    found = {
        "by_detector": every.where("direct").select("doc_id"),
        "by_response": parts.join(response_templates(parts, vocabulary), "template", "left_semi").select("doc_id"),
        "by_filler": filler(parts, vocabulary),
    }
    marked = reduce(DataFrame.unionByName, [df.select("doc_id", *[F.lit(name == other).alias(other) for other in found]) for name, df in found.items()])
    return marked.groupBy("doc_id").agg(*[F.max(name).alias(name) for name in found])
