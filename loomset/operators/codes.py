"""Standard codes: exact repeats, duplicates, and the resolution of collisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions.text import filled, strip


SALT = 16


def exact_repeats_removed(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of every set of rows that agree in ``key``; nulls agree with nulls.

    A minimum per key, not a window: the partial aggregate runs before the
    shuffle, so a record repeated a billion times costs one row per task.
    """
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("rest"))
    return first.select(*key, "rest.*").select(*rows.columns)


def duplicate_codes(rows: DataFrame, code: str, number: str) -> DataFrame:
    """(code, n_rows, first_row, last_row) of the codes that several rows bear."""
    coded = rows.select(filled(F.col(code)).alias("code"), F.col(number).alias("n")).where("code != ''")
    return coded.groupBy("code").agg(F.count("*").alias("n_rows"), F.min("n").alias("first_row"), F.max("n").alias("last_row")).where("n_rows > 1")


def prefix_candidates(*fields: Column) -> Column:
    """Short forms of the fields' segments: 2 to 4 letters of the initials, then of the letters, each once."""

    def of_part(part: Column) -> Column:
        tokens = F.regexp_extract_all(F.upper(part), F.lit("([A-Z0-9]+)"), F.lit(1))
        initials, letters = F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), ""), F.array_join(tokens, "")
        forms = [F.when(F.length(s) >= n, F.substring(s, 1, n)) for s in (initials, letters) for n in (2, 3, 4)]
        return F.array_compact(F.array(*forms))

    parts = [F.filter(F.transform(F.split(filled(f), r"\|"), strip), lambda p: p != "") for f in fields]
    return F.array_distinct(F.flatten(F.transform(F.concat(*parts), of_part)))


def code_suffix_raised(code: Column, by: int) -> Column:
    """The last number of a code raised, its leading zeros kept; '.n' where there is none."""
    head, digits, tail = (F.regexp_extract(code, r"^(.*?)([0-9]+)([^0-9]*)$", i) for i in (1, 2, 3))
    raised = (digits.try_cast("long") + by).cast("string")
    return F.when(digits == "", F.concat(code, F.lit(f".{by + 1}"))).otherwise(F.concat(head, F.when(F.length(raised) >= F.length(digits), raised).otherwise(F.lpad(raised, F.length(digits), "0")), tail))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a component in order: the first keeps its code, later ones take their first free candidate."""
    group, taken = None, set()
    for batch in batches:
        out = []
        for component, number, code, candidates in batch[["component", "n", "code", "candidates"]].itertuples(index=False):
            if component != group:
                group, taken = component, set()
            new = code if code not in taken else next((f"{p}.{code}" for p in candidates if f"{p}.{code}" not in taken), code)
            taken.add(new)
            out.append((number, code, new))
        yield pd.DataFrame(out, columns=["n", "code", "resolved"])


def _components(codes: DataFrame) -> DataFrame:
    """(code, component): codes that a prefix can turn into each other share a component.

    A rewritten code is a prefix, a dot and a raw code.  So a code touches the
    code without its first segment, if some row bears that, and so on.
    """
    segments = F.split("code", r"\.")
    leading = F.size(F.filter(segments, lambda x, i: (i < F.size(segments) - 1) & (F.size(F.filter(F.slice(segments, F.lit(1), i + 1), lambda y: ~y.rlike("^[A-Z0-9]{2,4}$"))) == 0)))
    endings = F.transform(F.sequence(F.lit(0), leading), lambda i: F.array_join(F.slice(segments, i + 1, F.size(segments)), "."))
    tried = codes.select("code", F.posexplode(endings).alias("cut", "ending"))
    borne = tried.join(codes.select(F.col("code").alias("ending")), "ending").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("cut", "ending"))).alias("chain"))
    chain = F.filter("chain", lambda x, i: x["cut"] == i)
    return borne.select("code", F.element_at(chain, -1)["ending"].alias("component"))


def resolved_collisions(rows: DataFrame, number: str, code: str, fields: list[str]) -> DataFrame:
    """(n, code, resolved): every row's code after colliding ones took a prefix.

    Only rows of crowded components are folded, in order.  Of rows with one code
    and the same candidates, those behind the first (candidates + 1) find none
    free, whatever else happens; they keep their code and never reach the fold,
    so a code that a third of all rows bear is thinned out in salted parts first.
    """
    coded = rows.select(F.col(number).alias("n"), filled(F.col(code)).alias("code"), prefix_candidates(*[F.col(f) for f in fields]).alias("candidates")).where("code != ''")
    counts = coded.groupBy("code").agg(F.count("*").alias("members"))
    component = _components(counts.select("code"))
    crowded = component.join(counts, "code").groupBy("component").agg(F.sum("members").alias("all")).where("all > 1").select("component")
    touched = component.join(crowded, "component", "left_semi")
    kept = coded.join(touched, "code", "left_anti").select("n", "code", F.col("code").alias("resolved"))
    folding = coded.join(touched, "code").withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALT)))
    for part in (["code", "candidates", "salt"], ["code", "candidates"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("n"))
        folding = folding.withColumn("early", rank <= F.size("candidates") + 1)
        kept = kept.unionByName(folding.where("not early").select("n", "code", F.col("code").alias("resolved")))
        folding = folding.where("early")
    folded = folding.repartition("component").sortWithinPartitions("component", "n").mapInPandas(_fold, "n long, code string, resolved string")
    return kept.unionByName(folded)


def ordered_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every group by ``order``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")
