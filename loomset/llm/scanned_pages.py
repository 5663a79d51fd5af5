"""Problem 1: noise of scanned pages, found line by line and repaired into paragraphs.

All of it is relational.  Texts become rows of lines; windows run over the lines
of one document.

*Edge lines.*  A line of a number alone, in one of the usual forms, is the number
of its page; bare numbers inside a list that a colon announces are not, unless
they continue the count.  A running header is a line beside a page number (or
holding one) that has words of the document's title or repeats through the
document, and whose pattern (title words masked, misreadings folded) stands at
the edge of pages all over the corpus.

*Misread words.*  Every word of the corpus gets an anagram value: the sum of the
hashes of its letters.  A misreading ("rn" for "m") shifts that value by a
constant, so the rare words that no clean text holds are joined to frequent
words by equality of (value - shift), for each known confusion in turn.  The
join is verified letter by letter; of several corrections the most frequent
word wins.

*Hyphens.*  A line that ends in a hyphen is joined with the next text line, over
edge lines and blank lines.  Counts of the whole corpus decide between the
joined word, the compound with its hyphen, and no cut at all.

Defined results: documents of other source types give no rows; null, empty and
one-line texts give what their lines show; of several texts under one id the
least counts; numbers are never words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.lookalike import consistent_text
from loomset.session import written

#: What scanners read for what was printed.
CONFUSIONS = [
    ("o", "0"), ("i", "1"), ("l", "1"), ("l", "i"), ("i", "l"), ("e", "c"), ("c", "e"), ("u", "ii"), ("h", "b"), ("b", "h"), ("t", "f"),
    ("f", "t"), ("n", "ri"), ("ri", "n"), ("s", "5"), ("g", "9"), ("b", "6"), ("m", "rn"), ("rn", "m"), ("in", "m"), ("m", "in"),
    ("d", "cl"), ("cl", "d"), ("z", "2"), ("q", "9"), ("w", "vv"), ("li", "h"), ("nn", "rm"), ("a", "o"), ("o", "a"), ("u", "n"), ("n", "u"),
]
WORD_LENGTH = 4
#: A right word is this many times as frequent as its misreading.
FREQUENT = 4
#: Share of a misreading's occurrences that clean text may hold, against that of scans.
CLEAN_SHARE = 0.1
#: Documents that must show a header's pattern, and share of its lines at page edges.
HEADER_DOCS, HEADER_EDGE = 3, 0.6
HEADER_LENGTH = 90
_DIGIT = "[0-9IlOoSB|]"
_NUMBER = rf"(?:[0-9]+|{_DIGIT}*[0-9]{_DIGIT}*|[Il|]|[ivx]+)"
PAGE_NUMBER = rf"^\s*(?:[-–—\[(]\s*)?(?:(?:[Pp]age|[Pp]\.|S\.|Seite|[Pp]ágina)\s*)?{_NUMBER}(?:\s*(?:/|of|von|de|sur)\s*{_NUMBER})?(?:\s*[-–—\])])?\s*$"
BARE_NUMBER = r"^\s*[0-9]+\s*$"
_WORDS = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"


def _skeleton(text: Column) -> Column:
    """The text with every letter folded with those it is misread for; numbers become #."""
    text = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}])[0-9]+(?![\p{L}\p{N}])", "#")
    text = F.translate(text, "1l0596hef", "iiosgbbct")
    for wide, narrow in (("ri", "n"), ("rn", "m"), ("ii", "u"), ("ci", "d"), ("in", "m")):
        text = F.replace(text, F.lit(wide), F.lit(narrow))
    return text


def _pattern_words(text: Column) -> Column:
    return F.regexp_extract_all(_skeleton(text), F.lit(r"([\p{L}\p{N}#]+)"), F.lit(1))


def document_lines(documents: DataFrame) -> DataFrame:
    """(document_id, line_no, line, scanned, names): the lines of every document, in consistent characters."""
    whole = documents.where(F.col("markdown").isNotNull()).select("document_id", F.coalesce("source_type", F.lit("")).alias("source_type"), "markdown")
    whole = consistent_text(whole, "markdown", into="text", changed="odd")
    # Of several texts under one id the least counts.
    whole = whole.groupBy("document_id").agg(F.min(F.struct("text", "source_type")).alias("d")).select("document_id", "d.*")
    # The words of the title are taken once a document, before it becomes a row for each line.
    scanned = F.col("source_type") == "pdf"
    names = F.when(scanned, _pattern_words(F.regexp_extract("text", r"^\s*#+ *([^\n]*)", 1)))
    whole = whole.select("document_id", scanned.alias("scanned"), names.alias("names"), F.split("text", "\n").alias("lines"))
    rows = whole.select("document_id", "scanned", "names", F.posexplode("lines").alias("at", "line"))
    return rows.select("document_id", (F.col("at") + 1).cast("int").alias("line_no"), "line", "scanned", "names")


def edge_lines(lines: DataFrame) -> DataFrame:
    """``lines`` of scanned documents that aren't blank, with ``kind``: page_number, header or text."""
    rows = lines.where(F.col("scanned") & F.col("line").rlike(r"\S"))
    order = Window.partitionBy("document_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numeric, bare = F.col("line").rlike(PAGE_NUMBER), F.col("line").rlike(BARE_NUMBER)
    rows = rows.withColumn("bare", bare).withColumn("numeric", numeric)
    # A list of counts: bare numbers line by line behind a line that ends in a colon.
    opens = ~F.col("bare") & F.col("line").rlike(r":\s*$")
    joined = F.col("bare") & (F.lag("line_no").over(order) == F.col("line_no") - 1)
    rows = rows.withColumn("begins", F.when(joined, 0).otherwise(1)).withColumn("block", F.sum("begins").over(order))
    block = Window.partitionBy("document_id", "block")
    rows = rows.withColumn("listed", F.col("bare") & (F.max(opens).over(block) | (F.sum(F.col("bare").cast("int")).over(block) >= 2)))
    rows = rows.withColumn("page", F.when(F.col("numeric") & ~F.col("listed"), F.regexp_extract("line", r"([0-9]+)", 1)))
    # The last number of a list is a page number if it continues the count on both sides.
    value = F.regexp_extract("line", r"([0-9]+)", 1).try_cast("long")
    known = F.col("page").try_cast("long")
    last = F.last(F.when(F.col("page").isNotNull(), known), ignorenulls=True).over(before)
    after = F.first(F.when(F.col("page").isNotNull(), known), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    ends = F.coalesce(F.lead("block").over(order) != F.col("block"), F.lit(True))
    styled = F.max(F.col("numeric") & ~F.col("bare")).over(Window.partitionBy("document_id"))
    # ... in a document whose page numbers are bare ones.
    goes_on = F.col("listed") & ends & ~F.col("styled") & (F.coalesce(F.col("last"), F.lit(0)) + 1 == F.col("value")) & (F.coalesce(F.col("after"), F.col("value") + 1) == F.col("value") + 1) & (F.col("last").isNotNull() | F.col("after").isNotNull())
    rows = rows.withColumn("styled", styled).withColumn("last", last).withColumn("after", after).withColumn("value", value)
    rows = rows.withColumn("is_page", F.coalesce((F.col("numeric") & ~F.col("listed")) | goes_on, F.lit(False)))

    # Bare numbers beside another style of page numbers are data.
    rows = rows.withColumn("is_page", F.col("is_page") & ~(F.col("bare") & F.col("styled")))
    beside = F.coalesce(F.lag("is_page").over(order), F.lit(False)) | F.coalesce(F.lead("is_page").over(order), F.lit(False))
    beside |= F.coalesce(F.lag("is_page", 2).over(order), F.lit(False)) | F.coalesce(F.lead("is_page", 2).over(order), F.lit(False))
    rows = rows.withColumn("beside", beside)
    plausible = (F.length(F.trim("line")) <= HEADER_LENGTH) & F.col("line").rlike(r"^\s*[\p{Lu}\p{N}]") & ~F.col("line").rlike(r"[.,;:]\s*$") & ~F.col("is_page")
    rows = rows.withColumn("tokens", F.when(plausible, _pattern_words(F.col("line"))))
    own_number = F.element_at("tokens", 1).eqNullSafe("#") | F.try_element_at("tokens", F.lit(-1)).eqNullSafe("#") & F.col("line").rlike(r"\s{2,}\S+\s*$")
    # Title words of a line that has a long one become one star.
    rows = rows.withColumn("words", F.filter("tokens", lambda t: t != "#"))
    rows = rows.withColumn("has_name", F.exists("words", lambda t: (F.length(t) > 3) & F.array_contains("names", t)))
    words, has_name = F.col("words"), F.col("has_name")
    masked = F.array_join(F.when(has_name, F.transform(words, lambda t: F.when(F.array_contains("names", t), "*").otherwise(t))).otherwise(words), " ")
    rows = rows.withColumn("pattern", F.regexp_replace(masked, r"\*(?: \*)+", "*")).withColumn("named", has_name & (F.size(words) >= 2)).withColumn("edge", F.col("beside") | own_number)
    rows = rows.withColumn("worded", F.coalesce(F.size("tokens") > 0, F.lit(False)))
    # Read twice below: for what the corpus says of a pattern, and for the lines themselves.
    rows = written(rows.select("document_id", "line_no", "line", "is_page", "worded", "pattern", "named", "edge"))
    candidates = rows.where("worded and pattern != ''")
    by_doc = candidates.groupBy("pattern", "document_id").agg(F.count("*").alias("n"), F.sum(F.col("edge").cast("int")).alias("edges"), F.max("named").alias("named"))
    by_pattern = by_doc.groupBy("pattern").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("edges").alias("edges"))
    at_edge = by_pattern.where(F.col("edges") >= HEADER_EDGE * F.col("n"))
    corpus = at_edge.where(F.col("docs") >= HEADER_DOCS).select("pattern", F.lit(True).alias("known"))
    # Known over the corpus with title words, or repeated through one document at its edges.
    # Most lines are no candidates; they are spread over their documents instead of meeting in one null.
    spread = F.coalesce(F.nullif("pattern", F.lit("")), F.concat(F.lit("\u0000"), "document_id"))
    rows = rows.withColumn("key", spread).join(corpus.withColumnRenamed("pattern", "key"), "key", "left")
    times = Window.partitionBy("document_id", "key")
    repeated = (F.count("*").over(times) >= 3) & (F.sum(F.col("edge").cast("int")).over(times) >= 0.8 * F.count("*").over(times))
    repeated |= (F.count("*").over(times) >= 2) & (F.sum(F.col("edge").cast("int")).over(times) == F.count("*").over(times)) & F.col("named")
    running = F.coalesce(F.col("worded") & (F.col("pattern") != "") & ((F.col("known") & F.col("named")) | repeated), F.lit(False))
    kind = F.when(F.col("is_page"), "page_number").when(running, "header").otherwise("text")
    return rows.select("document_id", "line_no", "line", kind.alias("kind"))


def anagram_value(word: Column) -> Column:
    """The sum of the hashes of the letters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: total + F.when(c == "", F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 40))))


def corrections(vocabulary: DataFrame) -> DataFrame:
    """(word, repaired) of misread words; ``vocabulary`` has word, clean and scans (counts)."""
    totals = vocabulary.agg(F.sum("clean").alias("clean"), F.sum("scans").alias("scans")).first()
    all_clean, all_scans = F.lit(totals.clean or 0), F.lit(totals.scans or 0)
    words = vocabulary.where((F.length("word") >= WORD_LENGTH) & F.col("word").rlike(r"\p{L}"))
    words = words.withColumn("total", F.col("clean") + F.col("scans")).withColumn("value", anagram_value(F.col("word")))
    suspect = (F.col("scans") > 0) & (F.col("clean") * F.greatest(all_scans, F.lit(1)) <= CLEAN_SHARE * F.col("scans") * all_clean)
    pairs = F.array(*[F.struct(F.lit(a).alias("right"), F.lit(b).alias("wrong")) for a, b in CONFUSIONS])
    rare = words.where(suspect).select(F.col("word").alias("odd"), F.col("total").alias("odd_total"), F.col("value").alias("odd_value"), F.inline(pairs))
    rare = rare.where(F.expr("contains(odd, wrong)")).withColumn("value", F.col("odd_value") - anagram_value(F.col("wrong")) + anagram_value(F.col("right")))
    frequent = words.where(F.col("total") >= FREQUENT).where(~F.col("word").rlike("[0-9]")).select("word", "total", "value")
    near = rare.join(frequent, "value").where(F.col("total") >= FREQUENT * F.col("odd_total"))
    places = F.sequence(F.lit(1), F.length("word"))
    swapped = lambda p: F.concat(F.expr("word").substr(F.lit(1), p - 1), F.col("wrong"), F.expr("word").substr(p + F.length("right"), F.length("word")))
    fits = F.exists(places, lambda p: (F.col("word").substr(p, F.length("right")) == F.col("right")) & (swapped(p) == F.col("odd")))
    ranked = near.where(fits).groupBy("odd").agg(F.max(F.struct("total", "word")).alias("best"))
    return ranked.select(F.col("odd").alias("word"), F.col("best.word").alias("repaired"))


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(rf"({_WORDS})"), F.lit(1))


def _noise(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines with their kind, text lines, misread words, cut words)."""
    lines = written(document_lines(documents))
    kinds = written(edge_lines(lines))
    order = Window.partitionBy("document_id").orderBy("line_no")
    text = kinds.where("kind = 'text'").withColumn("next_line", F.lead("line").over(order)).withColumn("last_line", F.lag("line").over(order))
    hyphen = r"\p{L}-\s*$"
    cut, cont = F.col("line").rlike(hyphen) & F.col("next_line").rlike(r"^\s*\p{L}"), F.coalesce(F.col("last_line").rlike(hyphen), F.lit(False))
    text = text.withColumn("cut", F.coalesce(cut, F.lit(False))).withColumn("tokens", _tokens(F.col("line")))
    # The two pieces of a cut are no words of their own.
    inner = F.slice("tokens", F.when(cont, 2).otherwise(1), F.greatest(F.size("tokens") - F.when(F.col("cut"), 1).otherwise(0) - F.when(cont, 1).otherwise(0), F.lit(0)))
    scans = text.select("document_id", "line_no", F.explode(inner).alias("word"))
    clean = lines.where(~F.col("scanned")).select(F.explode(_tokens(F.col("line"))).alias("word"))
    counted = scans.groupBy("word").agg(F.count("*").alias("scans")).withColumn("clean", F.lit(0).cast("long"))
    counted = counted.unionByName(clean.groupBy("word").agg(F.count("*").alias("clean")).withColumn("scans", F.lit(0).cast("long")))
    vocabulary = written(counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scans").alias("scans")))
    right = written(corrections(vocabulary))
    misread = scans.distinct().join(right, "word").select("document_id", "line_no", "word", "repaired")

    left, follow = F.element_at("tokens", -1), F.element_at(_tokens(F.col("next_line")), 1)
    cuts = text.where("cut").select("document_id", "line_no", left.alias("left"), follow.alias("follow")).where("left is not null and follow is not null")
    ways = F.array(F.struct(F.concat("left", "follow").alias("word"), F.lit(0).alias("hyphened")), F.struct(F.concat("left", F.lit("-"), "follow").alias("word"), F.lit(1).alias("hyphened")))
    tried = cuts.select("document_id", "line_no", "left", "follow", F.inline(ways))
    seen = vocabulary.where("clean + scans > 0").select("word", (F.col("clean") + F.col("scans")).alias("total"))
    known = tried.join(seen, "word", "left").join(right, "word", "left").join(seen.select(F.col("word").alias("repaired"), F.col("total").alias("right_total")), "repaired", "left")
    whole = F.coalesce("repaired", "word")
    weight = F.coalesce("right_total", "total", F.lit(0))
    best = known.groupBy("document_id", "line_no").agg(F.max(F.struct(weight.alias("weight"), (-F.col("hyphened")).alias("plain"), whole.alias("whole"))).alias("b"), F.max("left").alias("left"), F.max("follow").alias("follow"))
    # A word that stands before a hyphen and one behind it, in no known word together, make no cut,
    # unless a piece is itself no word.
    alone = best.join(seen.select(F.col("word").alias("left"), F.col("total").alias("left_total")), "left", "left").join(seen.select(F.col("word").alias("follow"), F.col("total").alias("follow_total")), "follow", "left")
    broken = F.least(F.coalesce("left_total", F.lit(0)), F.coalesce("follow_total", F.lit(0))) < FREQUENT
    repaired = F.when(F.col("b.weight") > 0, F.col("b.whole")).otherwise(F.concat("left", "follow"))
    hyphens = alone.where((F.col("b.weight") > 0) | broken).select("document_id", "line_no", repaired.alias("repaired"))
    return kinds, text, misread, hyphens


def page_noise(documents: DataFrame) -> DataFrame:
    """(document_id, line_no, kind, repaired) of the noise in scanned documents."""
    kinds, _, misread, hyphens = _noise(documents)
    kind = lambda name: F.lit(name).alias("kind")
    edges = kinds.where("kind != 'text'").select("document_id", "line_no", "kind", F.lit("").alias("repaired"))
    misread = misread.select("document_id", "line_no", kind("misread"), "repaired")
    return reduce(DataFrame.unionByName, [edges, misread, hyphens.select("document_id", "line_no", kind("hyphen"), "repaired")]).distinct()


def _capital(word: Column, like: Column) -> Column:
    return F.when(F.substring(like, 1, 1) != F.lower(F.substring(like, 1, 1)), F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))).otherwise(word)


def repaired_texts(documents: DataFrame) -> DataFrame:
    """(document_id, text): scanned documents as continuous paragraphs in right spelling, without page furniture.

    Headings, list entries, table rows and counts keep a line of their own.
    """
    _, text, misread, hyphens = _noise(documents)
    words = misread.groupBy("document_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("word", "repaired"))).alias("right"))
    rows = text.drop("kind", "next_line", "tokens").join(words, ["document_id", "line_no"], "left").join(hyphens, ["document_id", "line_no"], "left")
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = rows.withColumn("goes_on", F.lag("repaired").over(order).isNotNull()).withColumn("gap", F.col("line_no") - F.lag("line_no").over(order))
    right = F.coalesce("right", F.create_map().cast("map<string,string>"))
    pieces = F.regexp_extract_all("line", F.lit(r"([\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*|[^\p{L}\p{N}]+)"), F.lit(1))
    fixed = F.array_join(F.transform(pieces, lambda p: _capital(F.coalesce(F.try_element_at(right, F.lower(p)), p), p)), "")
    fixed = F.when(F.col("goes_on"), F.regexp_replace(fixed, rf"^\s*{_WORDS}", "")).otherwise(fixed)
    tail = F.regexp_extract(fixed, rf"({_WORDS})-\s*$", 1)
    fixed = F.when(F.col("repaired").isNotNull(), F.concat(F.regexp_replace(fixed, rf"{_WORDS}-\s*$", ""), _capital(F.col("repaired"), tail))).otherwise(fixed)
    own = F.col("line").rlike(r"^\s*(?:#+ |[-*•] |\d+[.)] |\||>|[0-9]+\s*$)")
    rows = rows.select("document_id", "line_no", "gap", "goes_on", own.alias("own"), F.when(F.col("goes_on"), F.rtrim(fixed)).otherwise(F.trim(fixed)).alias("piece"), F.col("line").rlike(r"[.!?:;»”\"')\]]\s*$").alias("ends"))
    last_own, last_ends = F.coalesce(F.lag("own").over(order), F.lit(True)), F.coalesce(F.lag("ends").over(order), F.lit(True))
    apart = F.when(F.col("goes_on"), F.lit("")).when((F.col("gap") > 1) & (last_ends | F.col("own") | last_own), "\n\n").when(F.col("own") | last_own, "\n").otherwise(" ")
    parts = rows.select("document_id", "line_no", F.concat(apart, "piece").alias("piece"))
    joined = parts.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return joined.select("document_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
