"""Page layout: joins of positioned text spans by place.

Spans are (doc, page, span, text, x0, y0, x1, y1).  Joins by nearness are
equality joins on bands of the coordinate, so no page is compared with itself
span by span beyond a band and its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where track labels stand, their lengths and how often they must occur.
TRACK_X, TRACK_CHARS, TRACK_COUNT, TRACKS = 400.0, (2, 8), 6, 5
#: Reach of an item to its text, and of a marker to an item.
TEXT_REACH, ITEM_REACH = 10.0, 60.0
HEADING = 1.2


def tracks(spans: DataFrame) -> DataFrame:
    """(doc, text, n, rank): the labels at the right that repeat, the five most frequent of a document."""
    label = spans.where((F.col("x0") >= TRACK_X) & F.length("text").between(*TRACK_CHARS) & F.col("text").rlike(r"^[A-Z]") & ~F.col("text").rlike(r"^[0-9]+$"))
    counted = label.groupBy("doc", "text").agg(F.count("*").alias("n")).where(F.col("n") >= TRACK_COUNT)
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "text"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= TRACKS)


def column_edges(spans: DataFrame, least: int = 4) -> DataFrame:
    """(doc, left, densest): the leftmost edge that enough spans share, from a histogram of rounded edges."""
    bins = spans.groupBy("doc", F.bround("x0", 0).alias("edge")).agg(F.count("*").alias("n"))
    top = bins.groupBy("doc").agg(F.max("n").alias("densest")).where(F.col("densest") >= least)
    near = bins.join(top, "doc").where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("densest") / 2)))
    return near.groupBy("doc", "densest").agg(F.min("edge").alias("left"))


def within_reach(left: DataFrame, right: DataFrame, on: list[str], left_y: str, right_y: str, reach: float) -> DataFrame:
    """All pairs of the same ``on`` whose coordinates differ by at most ``reach``: a join on bands of that width."""
    bands = F.explode(F.array(*[F.floor(F.col(left_y) / reach) + d for d in (-1, 0, 1)]))
    wide = left.withColumn("band", bands)
    return wide.join(right.withColumn("band", F.floor(F.col(right_y) / reach)), [*on, "band"]).where(F.abs(F.col(left_y) - F.col(right_y)) <= reach).drop("band")


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, left_y: str, right_y: str, reach: float) -> DataFrame:
    """(on, left_id, right_id, distance): the nearest of ``right`` to each of ``left`` within reach, the lowest id of equals."""
    pairs = within_reach(left.select(*on, left_id, left_y), right.select(*on, right_id, right_y), on, left_y, right_y, reach)
    best = F.min(F.struct(F.abs(F.col(left_y) - F.col(right_y)).alias("distance"), F.col(right_id).alias("id"))).alias("b")
    return pairs.groupBy(*on, left_id).agg(best).select(*on, left_id, F.col("b.id").alias(right_id), F.col("b.distance").alias("distance"))


def item_text(items: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, page, item, n_spans, text): the spans beside every item, in reading order."""
    pairs = within_reach(items.select("doc", "page", "item", "item_y"), spans.select("doc", "page", "span", "x0", "y0", "text"), ["doc", "page"], "item_y", "y0", TEXT_REACH)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "span", "text"))), lambda s: s["text"]), " ")
    return pairs.groupBy("doc", "page", "item").agg(F.count("*").alias("n_spans"), words.alias("text"))


def page_headings(blocks: DataFrame) -> DataFrame:
    """(doc, page, baseline, headings): the median size of a page's blocks, and how many stand out from it."""
    base = blocks.groupBy("doc", "page").agg(F.median("size").alias("baseline"))
    return blocks.join(base, ["doc", "page"]).groupBy("doc", "page", "baseline").agg(F.sum((F.col("size") >= HEADING * F.col("baseline")).cast("int")).alias("headings"), F.count("*").alias("blocks"))
