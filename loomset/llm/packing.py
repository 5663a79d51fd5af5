"""Problem 7: documents into containers of a fixed number of tokens.

Harmonic packing.  A length in (C/(j+1), C/j] belongs to class j, and j
documents of class j always fit one bin of capacity C, whatever their lengths.
So bins are filled by count alone: the documents of a class are dealt into
lanes, numbered inside their lane, and every j of them make a bin.  Lanes do
not know of each other, so workers fill bins independently; a class of a third
of all rows has as many lanes as it needs.

The bins of the first classes hold few long documents and leave the most room
(half a bin in class 1).  There the harmonic bins are topped up, as in Harmonic
Match: the room of a bin and the lengths of shorter documents are put in steps
of ``STEP`` tokens, and the n-th bin of a step takes the n-th document of that
step, an equality join inside lanes.  What was taken leaves its own class.

Texts are measured by a byte-level BPE of the ``tokenizers`` or ``tiktoken``
kind; only ids and sizes are shuffled.

Defined results: a text beyond the capacity is split into full bins and a rest,
which is packed like any other; nothing else is split.  Null and empty texts
have no tokens and get no bin.  Repeated rows are separate items if their ids
differ; of rows with one id the largest counts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.session import written

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Shortest class; lengths up to capacity / LAST share it.
LAST = 64
#: Documents of a class that one lane numbers.
LANE_ROWS = 20_000
STEP = 8
#: A text is given to the tokenizer in parts of this many characters, cut before a space.
PART = 1 << 16


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_CUT = re.compile(r"(?s).{1,%d}(?!\S)|\S{1,%d}" % (PART, PART))


def token_sizes(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, size): tokens of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        size = lambda t: sum(len(encoding.encode_ordinary(p)) for p in (_CUT.findall(t) if len(t) > PART else [t]))
        for batch in batches:
            yield pd.DataFrame({key: batch["key"], "size": [size(t) for t in batch["text"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text) != "").select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, size long")


def _numbered(df: DataFrame, by: str) -> DataFrame:
    """Number the rows of every value of ``by`` inside lanes of about ``LANE_ROWS`` rows."""
    lanes = df.groupBy(by).agg(F.ceil(F.count("*") / LANE_ROWS).alias("lanes"))
    dealt = df.join(lanes, by).withColumn("lane", F.pmod(F.xxhash64("item", "part"), F.col("lanes"))).drop("lanes")
    return dealt.withColumn("n", F.row_number().over(Window.partitionBy(by, "lane").orderBy(F.desc("size"), "item", "part")) - 1)


def _matched(hosts: DataFrame, guests: DataFrame) -> DataFrame:
    """(item, part, size, bin): guests that take the room of the hosts (bin, room), one each."""
    steps = hosts.select(F.col("bin").alias("item"), F.lit(0).alias("part"), F.col("room").alias("size"), F.floor(F.col("room") / STEP).alias("step"))
    want = guests.withColumn("step", F.ceil(F.col("size") / STEP))
    # Both sides of a step are dealt into the same lanes, so that numbers can meet.
    # The larger side of a step says how many lanes it needs.
    both = steps.select("step", F.lit(1).alias("host")).unionByName(want.select("step", F.lit(0).alias("host")))
    lanes = both.groupBy("step").agg(F.greatest(F.sum("host"), F.count("*") - F.sum("host")).alias("n")).select("step", F.ceil(F.col("n") / LANE_ROWS).alias("lanes"))

    def deal(df: DataFrame) -> DataFrame:
        dealt = df.join(lanes, "step").withColumn("lane", F.pmod(F.xxhash64("item", "part"), F.col("lanes"))).drop("lanes")
        return dealt.withColumn("n", F.row_number().over(Window.partitionBy("step", "lane").orderBy(F.desc("size"), "item", "part")))

    bins = deal(steps).select("step", "lane", "n", F.col("item").alias("bin"))
    return deal(want).join(bins, ["step", "lane", "n"]).select("item", "part", "size", "bin")


def _bin(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def _by_count(items: DataFrame) -> DataFrame:
    """(item, part, size, bin): every j items of class j in a bin, lane by lane."""
    bins = _bin(F.lit("class"), F.col("class"), F.col("lane"), F.floor(F.col("n") / F.col("class")))
    return _numbered(items, "class").select("item", "part", "size", bins.alias("bin"))


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY, topped: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """(key, part, size, bin): the container of every item, or of its parts if it exceeds the capacity.

    ``topped`` are the classes whose bins are filled up with one shorter item each.
    """
    whole = sizes.where("size > 0").groupBy(F.col(key).alias("item")).agg(F.max("size").alias("size"))
    last = F.ceil(F.col("size") / capacity) - 1
    cut = whole.select("item", F.col("size").alias("total"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("part"))
    parts = cut.select("item", "part", F.least(F.lit(capacity), F.col("total") - F.col("part") * capacity).alias("size"))
    rest = written(parts.withColumn("class", F.least(F.lit(LAST), F.floor(F.lit(capacity) / F.col("size"))).cast("int")))
    placed = []
    for number in topped:
        own = written(_by_count(rest.where(F.col("class") == number)))
        rest = rest.where(F.col("class") > number)
        hosts = own.groupBy("bin").agg((F.lit(capacity) - F.sum("size")).alias("room")).where("room > 0")
        taken = written(_matched(hosts, rest))
        rest = written(rest.join(taken, ["item", "part"], "left_anti"))
        placed += [own, taken]
    placed.append(_by_count(rest))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("item", key)
