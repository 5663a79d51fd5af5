"""Problem 4: the main body of web pages.

Nearest-URL page differencing.  Pages are sorted by host and URL path over the
whole cluster, each is paired with the pages just before it on its host, and
their text lines are aligned by longest common subsequence.  A host may hold a
third of all pages: a range sort by (host, path) splits it over any number of
tasks, and a task streams its pages keeping only the last few.  The pages at
either end of a task's range are compared across the seam afterwards.

A line (host name, site name, numbers, URLs and list marks masked) that such
pairs share time and again, on a host or over the hosts, is what the site puts
around its pages.  Lines that documents of other kinds hold as well (headings
of sections) are subject matter and stay.  Shared lines are deleted, and with
them what hangs on them:

* bread crumbs and menus in one line, if their first or last item is one of a shared line;
* blocks of short unmarked lines, and boxes: a heading with entries right below;
* lists of which half the entries are shared lines;
* single unmarked lines that recur on pages of several hosts, and end no
  sentence or name their site.

Tables, quotations, set-off titles and sentences stay.

Defined results: line numbers count from 1, blank lines included and never
reported; null and empty pages give nothing; pages without a URL are put with
the host of their first link, or their id's first word; of several texts under
one id the least counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.lookalike import consistent_text
from loomset.session import written

#: Pages before a page, in URL order, that it is compared with.
NEIGHBOURS = 3
#: Share of comparisons in which a line is common, from which the site put it there.
SHARED_ON_HOST, SHARED_ANYWHERE = 0.5, 0.25
#: With fewer comparisons on a host, the line's share over all hosts may speak against it.
COMPARED = 4
#: Hosts that a share over all hosts needs.
HOSTS = 3
#: Pages and hosts on which a set-off line recurs.
RECURS_PAGES, RECURS_HOSTS = 3, 2

_MARK = r"^\s*(?:[-*+•]|\d+\.)\s+"
_MARKED = r"^\s*(?:[-*+•]\s|\d+\.\s|\||>|\*\*)"


def common_lines(a: list[str], b: list[str]) -> set[str]:
    """The lines of a longest common subsequence (Hunt and Szymanski: matches, then an increasing run)."""
    places = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    tails: list[int] = []
    ends: list[tuple[int, object]] = []
    for line in a:
        for j in reversed(places.get(line, ())):
            k = bisect_left(tails, j)
            node = (line, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j), ends.append(node)
            else:
                tails[k], ends[k] = j, node
    found, node = set(), ends[-1] if ends else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


_SEAM = "host string, core string, compared long, shared long, path string, document_id string, cores array<string>, range int"
_COUNTS = ["host", "core", "compared", "shared"]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the pairs within a range of pages, and the pages at its two ends."""
    here, seen = TaskContext.get().partitionId(), 0
    last: deque[tuple] = deque(maxlen=NEIGHBOURS)
    for batch in batches:
        ends = []
        counts = _Counts()
        for host, path, document, cores in zip(batch["host"], batch["path"], batch["document_id"], batch["cores"], strict=True):
            own = [c for c in cores if c]
            for other_host, _, _, other, _ in last:
                counts.add(host, own, other_host, other)
            last.append((host, path, document, own, seen))
            if seen < NEIGHBOURS:
                ends.append((host, None, None, None, path, document, own, here))
            seen += 1
        yield pd.DataFrame([(*c, None, None, None, here) for c in counts.rows()] + ends, columns=[*_COUNTS, "path", "document_id", "cores", "range"])
    rest = [(host, None, None, None, path, document, own, here) for host, path, document, own, at in last if at >= NEIGHBOURS]
    yield pd.DataFrame(rest, columns=[*_COUNTS, "path", "document_id", "cores", "range"])


def _compare_seams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the pairs whose pages lie in different ranges."""
    last: deque[tuple] = deque(maxlen=NEIGHBOURS)
    for batch in batches:
        counts = _Counts()
        for host, cores, here in zip(batch["host"], batch["cores"], batch["range"], strict=True):
            own = list(cores)
            for other_host, other, there in last:
                if there != here:
                    counts.add(host, own, other_host, other)
            last.append((host, own, here))
        yield pd.DataFrame(counts.rows(), columns=_COUNTS)


class _Counts:
    """How often the lines of a host were compared, and were common; a page and its copy say nothing."""

    def __init__(self) -> None:
        self.compared: Counter = Counter()
        self.shared: Counter = Counter()

    def add(self, host: str, own: list[str], other_host: str, other: list[str]) -> None:
        if other_host != host or own == other:
            return
        for line in {*own, *other}:
            self.compared[host, line] += 1
        for line in common_lines(own, other):
            self.shared[host, line] += 1

    def rows(self) -> list[tuple]:
        return [(host, core, n, self.shared[host, core]) for (host, core), n in self.compared.items()]


def _core(line: Column, site: Column) -> Column:
    """The line as its site would repeat it: masks instead of names, numbers and URLs."""
    text = F.regexp_replace(F.lower(line), r"(\]\([^)\s]*\))\s*(?=\[)", "$1 | ")
    text = F.regexp_replace(text, r"\[([^\]]*)\]\([^)\s]*\)", "$1")
    text = F.regexp_replace(text, r"https?://\S+|(?<![\w-])[\w-]++(?:\.[\w-]++)++", "@")
    text = F.regexp_replace(text, r"^\s*(?:[-*+•]\s+|#+\s*|>\s*)+", "")
    text = F.regexp_replace(F.when(site != "", F.replace(text, site, F.lit("@"))).otherwise(text), r"[0-9]+", "#")
    return F.trim(F.regexp_replace(F.replace(text, F.lit("**"), F.lit("")), r"\s+", " "))


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_id, host, path, line_no, line, core, block, title): lines of web pages that aren't blank."""
    web = pages.where((F.col("source_type") == "website") & (F.col("markdown") != ""))
    web = web.select("document_id", F.element_at("metadata", "url").alias("url"), "markdown")
    web = consistent_text(web, "markdown", into="text", changed="odd")
    web = web.groupBy("document_id").agg(F.min(F.struct("text", "url")).alias("page")).select("document_id", "page.*")
    linked = F.regexp_extract("text", r"https?://([^/\s)]+)", 1)
    host = F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.lit("")), F.nullif(linked, F.lit("")), F.regexp_extract("document_id", r"^(\p{L}*)", 1))
    web = web.withColumn("host", F.lower(host)).withColumn("path", F.coalesce(F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1), F.lit("")))
    # The site's own name: the letters that begin the registered part of the host.
    site = F.regexp_extract("host", r"(\p{L}+)[^.]*(?:\.[^.]*)?$", 1)
    rows = web.select("document_id", "host", "path", site.alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    # A block ends at a blank line, and before a heading that stands right below other lines.
    order = Window.partitionBy("document_id").orderBy("at")
    rule = r"^\s*(?:={3,}|-{3,})\s*$"
    underlined = F.coalesce(F.lead("line").over(order).rlike(rule) & F.col("line").rlike(r"^\s*[\p{L}\p{N}]"), F.lit(False))
    title = underlined | F.col("line").rlike(r"^\s*(?:#+ |\*\*.*\*\*\s*$)")
    rows = rows.withColumn("title", underlined).withColumn("block", F.sum((F.col("line").rlike(r"^\s*$") | title).cast("int")).over(order))
    rows = rows.where(F.col("line").rlike(r"\S")).withColumn("line_no", (F.col("at") + 1).cast("int"))
    return rows.select("document_id", "host", "path", "line_no", "line", _core(F.col("line"), F.col("site")).alias("core"), "block", "title")


def shared_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, core) shared on a host, (core) shared over the hosts)."""
    pages = lines.groupBy("host", "path", "document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "core"))), lambda x: x["core"]).alias("cores"))
    pages = pages.repartitionByRange("host", "path", "document_id").sortWithinPartitions("host", "path", "document_id")
    ranges = written(pages.mapInPandas(_compare, _SEAM))
    seams = ranges.where(F.col("cores").isNotNull()).repartition("host").sortWithinPartitions("host", "path", "document_id")
    counted = ranges.where(F.col("core").isNotNull()).select(*_COUNTS).unionByName(seams.mapInPandas(_compare_seams, "host string, core string, compared long, shared long"))
    counted = written(counted.groupBy("host", "core").agg(F.sum("compared").alias("compared"), F.sum("shared").alias("shared")))
    total = counted.groupBy("core").agg(F.sum("compared").alias("all_compared"), F.sum("shared").alias("all_shared"), F.sum((F.col("shared") > 0).cast("int")).alias("hosts"))
    often = F.col("all_shared") >= SHARED_ANYWHERE * F.col("all_compared")
    own = counted.where((F.col("shared") > 0) & (F.col("shared") >= SHARED_ON_HOST * F.col("compared")))
    local = own.join(total, "core").where((F.col("compared") >= COMPARED) | often).select("host", "core")
    wide = total.where((F.col("hosts") >= HOSTS) & often).select("core")
    return local, wide


def line_marks(lines: DataFrame, subject: DataFrame) -> DataFrame:
    """(host, core, known, recurs): what the comparison says of a host's line, for lines of which it says something.

    Worked out once for each distinct line of a host, whatever the number of its pages.
    """
    local, wide = (df.join(subject, "core", "left_anti") for df in shared_lines(lines))
    local, wide = written(local), written(wide)
    keys = written(lines.groupBy("host", "core").agg(F.countDistinct("document_id").alias("pages")))
    recurring = keys.groupBy("core").agg(F.sum("pages").alias("pages"), F.count("*").alias("hosts")).where((F.col("pages") >= RECURS_PAGES) & (F.col("hosts") >= RECURS_HOSTS))
    items = F.split("core", r"\s*[|/›»>]\s*|\s{2,}")
    entries = wide.unionByName(local.select("core")).select(F.explode(items).alias("item")).select(F.trim("item").alias("item")).where(F.length("item") >= 2).distinct()
    # Bread crumbs and menus in one line: the first or the last item.
    ends = keys.where(F.size(items) >= 2).select("host", "core", F.explode(F.array(F.trim(items[0]), F.trim(F.element_at(items, -1)))).alias("item"))
    known = local.unionByName(keys.join(wide, "core", "left_semi").select("host", "core")).unionByName(ends.join(entries, "item", "left_semi").select("host", "core"))
    marks = known.select("host", "core", F.lit(True).alias("known"), F.lit(False).alias("recurs"))
    marks = marks.unionByName(keys.join(recurring, "core", "left_semi").select("host", "core", F.lit(False).alias("known"), F.lit(True).alias("recurs")))
    return marks.groupBy("host", "core").agg(F.max("known").alias("known"), F.max("recurs").alias("recurs"))


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(document_id, line_no) of the lines of web pages that aren't part of the main body."""
    lines = written(page_lines(pages))
    other = pages.where((F.coalesce("source_type", F.lit("")) != "website") & F.col("markdown").isNotNull())
    headings = other.select(F.explode(F.split("markdown", "\n")).alias("line")).where(F.col("line").rlike(r"^#+ ")).distinct()
    headings = consistent_text(headings, "line", into="text", changed="odd")
    subject = headings.select(_core(F.col("text"), F.lit("")).alias("core")).distinct()
    rows = lines.join(line_marks(lines, subject), ["host", "core"], "left")

    marked, heading = F.col("line").rlike(_MARKED), F.col("line").rlike(r"^\s*#+ ")
    kept = F.col("title") | F.col("line").rlike(r"^\s*(?:\||>|\*\*)|^\s*(?:={3,}|-{3,})\s*$")
    sentence = F.col("line").rlike(r"[.!?…:;»”\"']\s*$")
    known = ~kept & F.coalesce("known", F.lit(False))
    rows = rows.withColumn("known", known).withColumn("marked", marked).withColumn("heading", heading).withColumn("kept", kept).withColumn("sentence", sentence)
    block = Window.partitionBy("document_id", "block")
    order = block.orderBy("line_no")
    size, first = F.count("*").over(block), F.row_number().over(order) == 1
    leads = F.first(F.when(F.col("marked") | F.col("kept"), "list").when(F.col("heading"), "heading").otherwise("plain")).over(order)
    flows = F.sum(F.col("line").rlike(r"^\s*\p{Ll}").cast("int")).over(block)
    hits = F.sum(F.col("known").cast("int")).over(block)
    sentences = F.sum((F.col("sentence") & ~F.col("known")).cast("int")).over(block)
    # A box or a block of entries; wrapped prose has sentences in it, and goes on in small letters.
    loose = (size >= 2) & leads.isin("plain", "heading") & ((hits > 0) | (flows == 0)) & ((sentences * 2 < size) | (hits * 2 >= size))
    listed = (size >= 2) & (leads == "list") & (hits * 2 >= size)
    alone = (size == 1) & ~F.col("marked") & ~F.col("heading") & ~F.col("kept") & (~F.col("sentence") | F.col("core").contains("@")) & F.coalesce("recurs", F.lit(False))
    out = F.col("known") | ((loose | listed) & ~F.col("kept")) | alone
    return rows.withColumn("out", out).where("out").select("document_id", "line_no").distinct()


def main_bodies(pages: DataFrame) -> DataFrame:
    """(document_id, body): the main body of every web page, lines in their order."""
    web = pages.where((F.col("source_type") == "website") & F.col("markdown").isNotNull()).groupBy("document_id").agg(F.min("markdown").alias("markdown"))
    gone = boilerplate_lines(pages).groupBy("document_id").agg(F.collect_set("line_no").alias("gone"))
    body = F.filter(F.transform(F.split("markdown", "\n"), lambda line, i: F.when(~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), (i + 1).cast("int")), line)), lambda x: x.isNotNull())
    return web.join(gone, "document_id", "left").select("document_id", F.regexp_replace(F.regexp_replace(F.array_join(body, "\n"), r"\n\s*\n(?:\s*\n)+", "\n\n"), r"^\s+|\s+$", "").alias("body"))
