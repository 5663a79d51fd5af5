"""Problem 3: several values packed in one field, one value per row with its place.

The column itself teaches what a value is.  Every string is reduced to a shape
(digits masked, quoted spans one atom); shapes are counted over the whole
column.  A shape is a lattice: its candidate boundaries are the gaps between
atoms (delimiters, "and", spaces between numbers, quoted spans and single
letters), its edges the pieces between two boundaries.

Expectation-maximisation learns two things from all strings at once: how
frequent each piece is as a value, and, for each kind of gap (delimiter and the
kinds of atoms beside it), how often it lies inside a value rather than between
two.  Forward-backward over each lattice gives the expected counts; a join on
the piece brings the frequencies to the edges, so no vocabulary goes through
the driver.  All kinds of gaps start alike; what divides values and what belongs
to them is learned.  A Viterbi pass then chooses the likeliest split of each
shape, and the rows are split at the same places.  Quoted spans are never cut.

Edges are all pieces of fewer than ``ORDER`` gaps, and the longer ones from one gap
of a kind, or a stronger kind, to the next.  Any other long piece is taken for one
not seen before: its cost is a sum over its gaps, so all of them go through one
running state of the lattice.  So no piece is left out, and a string of any length
takes time in proportion to it.

Defined results: null, blank and single values give no rows; leading, trailing
and doubled delimiters make no values; a range of whole numbers outside quotes
stands for every number in it, if it rises (a falling one stays whole, and so
does one of more numbers than a position can count).
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.session import written

ROUNDS = 3
#: Ranges up to this width become arrays; wider ones are spread over rows.
RANGE_WIDTH = 10_000
#: Positions are 32-bit integers.
WIDEST = (1 << 31) - 1
#: Pieces of fewer gaps are all edges of their own.
ORDER = 12
SALT = 8
#: Probability of a piece not seen before, and what every gap inside it costs.
UNSEEN, UNSEEN_GAP = math.log(1e-7), math.log(1e-6)
#: Taken off every expected count, so that a piece nobody needs isn't learned by heart.
DISCOUNT = 0.5
#: Prior share of the gaps of any kind that lie inside a value, and its weight in observations.
PRIOR, PRIOR_WEIGHT = 0.5, 10.0

TOKEN = r'"(?:[^"]|"")*"|(?:[0-9]+|#)\s*(?:-|–|—|to)\s*(?:[0-9]+|#)|\s+|[,;|/&]|[^\s,;|/&"]+|"'
_TOKEN = re.compile(TOKEN)
_PLAIN = re.compile(r"[A-Za-z]|#(?:\s*(?:-|–|—|to)\s*#)?")
EDGES = "field_name string, shape_id long, weight double, first int, last int, piece string, gaps array<int>, begins array<int>, ends array<int>"
#: The kinds of gaps by their sign, the strongest first, and the kinds of atoms beside one.
SIGNS = {"pipe": "|", "semi": ";", "line": "\n", "comma": ",", "slash": "/", "amp": "&", "and": "and", "space": ""}
ATOMS = "qnw"
KINDS = len(SIGNS) * len(ATOMS) ** 2


def _gap(text: str) -> str:
    return next(kind for kind, sign in SIGNS.items() if sign in text)


def _atom(text: str) -> str:
    return "q" if text[0] == '"' and len(text) > 1 else "n" if _PLAIN.fullmatch(text) else "w"


def _lattice(shape: str) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Tokens of a shape and its segments' (first token, last token, kind of the gap behind or -1)."""
    tokens = _TOKEN.findall(shape)
    is_gap = [bool(re.fullmatch(r"\s+|[,;|/&]", t)) for t in tokens]
    for i in range(1, len(tokens) - 1):
        if tokens[i].lower() == "and" and is_gap[i - 1] and is_gap[i + 1]:
            is_gap[i] = True
    atoms = [i for i, g in enumerate(is_gap) if not g]
    parts: list[tuple[int, int, str]] = []
    begin = atoms[0] if atoms else 0
    for a, b in zip(atoms, atoms[1:], strict=False):
        if b == a + 1:
            continue
        kind, left, right = _gap("".join(tokens[a + 1 : b])), _atom(tokens[a]), _atom(tokens[b])
        if kind != "space" or "w" not in (left, right):
            parts.append((begin, a, (list(SIGNS).index(kind) * len(ATOMS) + ATOMS.index(left)) * len(ATOMS) + ATOMS.index(right)))
            begin = b
    if atoms:
        parts.append((begin, atoms[-1], -1))
    return tokens, parts


def _long(gaps: list[int]) -> set[tuple[int, int]]:
    """The longer spans from one gap of a kind or a stronger kind to the next such gap, the whole string among them."""
    spans = set()
    for strength in range(-1, len(SIGNS)):
        ends = [k for k, gap in enumerate(gaps) if gap // len(ATOMS) ** 2 <= strength] + [len(gaps)]
        spans |= {(a + 1, b) for a, b in zip([-1, *ends], ends, strict=False) if b - a > ORDER}
    return spans


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for field, shape_id, shape, weight in batch[["field_name", "shape_id", "shape", "weight"]].itertuples(index=False):
            tokens, parts = _lattice(shape)
            n = len(parts)
            # What belongs to the shape stands in its first edge only.
            about = ([p[2] for p in parts[:-1]], [p[0] for p in parts], [p[1] for p in parts])
            spans = {(i, j) for i in range(n) for j in range(i, min(n, i + ORDER))} | (_long(about[0]) if n > ORDER else set())
            for i, j in sorted(spans):
                piece = re.sub(r"\s+", " ", "".join(tokens[parts[i][0] : parts[j][1] + 1]))
                out.append((field, shape_id, weight, i, j, piece, *(about if i == j == 0 else (None,) * 3)))
        yield pd.DataFrame(out, columns=["field_name", "shape_id", "weight", "first", "last", "piece", "gaps", "begins", "ends"])


def _plus(a: float, b: float) -> float:
    top = max(a, b)
    return top if top == -math.inf else top + math.log(math.exp(a - top) + math.exp(b - top))


class _Scores:
    """The log scores of a shape's edges: known pieces one by one, long unseen ones as a running sum."""

    def __init__(self, firsts, lasts, shares, gaps, inside: list[float]) -> None:
        self.n = n = len(gaps) + 1
        # until[k]: the cost of the first k gaps, if they lie inside values.
        self.until = [0.0]
        for g in gaps:
            self.until.append(self.until[-1] + math.log(inside[g]))
        self.behind = [math.log1p(-inside[g]) for g in gaps] + [0.0]
        self.edges = []
        for e, (i, j, p) in enumerate(zip(firsts, lasts, shares, strict=True)):
            s = max(math.log(p) if p > 0 else -math.inf, UNSEEN + (j - i) * UNSEEN_GAP) + self.until[j] - self.until[i] + self.behind[j]
            self.edges.append((i, j, s, e))
        self.edges.sort()
        # The same for pieces that are unseen whatever they are.
        self.enter = [-self.until[k] - k * UNSEEN_GAP for k in range(n)]
        self.leave = [UNSEEN + self.until[k] + k * UNSEEN_GAP + self.behind[k] for k in range(n)]

    def forward(self, plus) -> tuple[list[float], list[float]]:
        """For every boundary the total before it, and over the entries of running pieces."""
        ahead, running = [0.0] + [-math.inf] * self.n, [-math.inf] * self.n
        at = 0
        for i in range(self.n):
            if i > ORDER - 1:
                ahead[i + 1] = plus(ahead[i + 1], running[i - ORDER] + self.leave[i])
            # Edges into boundary i come from earlier ones, so it is complete here.
            running[i] = plus(running[i - 1] if i else -math.inf, ahead[i] + self.enter[i])
            while at < len(self.edges) and self.edges[at][0] == i:
                _, j, s, _ = self.edges[at]
                ahead[j + 1] = plus(ahead[j + 1], ahead[i] + s)
                at += 1
        return ahead, running


def _expected(inside: dict[str, list[float]]):
    """Forward-backward: expected counts of the pieces and of gaps inside and between values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mass: dict[tuple[str, str, int], float] = defaultdict(float)
            for field, weight, firsts, lasts, shares, pieces, gaps in batch[["field_name", "weight", "firsts", "lasts", "shares", "pieces", "gaps"]].itertuples(index=False):
                x = _Scores(firsts, lasts, shares, gaps, inside[field])
                n = x.n
                ahead, entered = x.forward(_plus)
                back, left = [-math.inf] * n + [0.0], [-math.inf] * n
                at = len(x.edges)
                for i in range(n - 1, -1, -1):
                    while at and x.edges[at - 1][0] == i:
                        at -= 1
                        _, j, s, _ = x.edges[at]
                        back[i] = _plus(back[i], back[j + 1] + s)
                    if i + ORDER < n:
                        back[i] = _plus(back[i], x.enter[i] + left[i + ORDER])
                    left[i] = _plus(left[i + 1] if i + 1 < n else -math.inf, x.leave[i] + back[i + 1])
                within = [0.0] * n  # expected values that go on behind each segment
                for i, j, s, e in x.edges:
                    share = weight * math.exp(ahead[i] + s + back[j + 1] - ahead[n])
                    mass[field, "piece", int(pieces[e])] += share
                    for k in range(i, j):
                        within[k] += share
                    if j < n - 1:
                        mass[field, "between", int(gaps[j])] += share
                running = 0.0
                for k in range(n - 1):
                    running += weight * math.exp(ahead[k] + x.enter[k] + left[k + ORDER] - ahead[n]) if k + ORDER < n else 0.0
                    if k >= ORDER:
                        ended = weight * math.exp(entered[k - ORDER] + x.leave[k] + back[k + 1] - ahead[n])
                        running -= ended
                        mass[field, "between", int(gaps[k])] += ended
                    mass[field, "inside", int(gaps[k])] += within[k] + max(running, 0.0)
            yield pd.DataFrame([(*k, v) for k, v in mass.items()], columns=["field_name", "kind", "name", "mass"])

    return run


def _best(inside: dict[str, list[float]]):
    """Viterbi: (first token, last token) of each value of a shape."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for field, shape_id, firsts, lasts, shares, gaps, begins, ends in batch[["field_name", "shape_id", "firsts", "lasts", "shares", "gaps", "begins", "ends"]].itertuples(index=False):
                x = _Scores(firsts, lasts, shares, gaps, inside[field])
                best, running = x.forward(max)
                into = defaultdict(list)
                for i, j, s, _ in x.edges:
                    into[j + 1].append((i, s))
                cuts, at = [], x.n
                while at:
                    known = [i for i, s in into[at] if best[i] + s == best[at]]
                    # None: a long piece, whose entry is the best of those that lie far enough before.
                    i = known[0] if known else next(k for k in range(at - ORDER) if best[k] + x.enter[k] == running[at - 1 - ORDER])
                    cuts.append([int(begins[i]), int(ends[at - 1])])
                    at = i
                out.append((field, shape_id, cuts[::-1]))
            yield pd.DataFrame(out, columns=["field_name", "shape_id", "cuts"])

    return run


def bare(value: Column) -> Column:
    """Without the brackets around the whole list."""
    return F.regexp_replace(value, r"(?s)^\s*\[(.*)\]\s*[;,|]?\s*$", "$1")


def shape_of(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r'"(?:[^"]|"")*"', '"Q"'), r"[0-9]+", "#")


def _shape_id() -> Column:
    return F.xxhash64("field_name", "shape")


def learned_cuts(strings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(field_name, shape_id, cuts) learned from all strings (field_name, value)."""
    shapes = strings.groupBy("field_name", shape_of(F.col("value")).alias("shape")).agg(F.count("*").cast("double").alias("weight"))
    edges = shapes.withColumn("shape_id", _shape_id()).mapInPandas(_edges, EDGES)
    # Shapes and pieces are numbers from here on.
    edges = written(edges.withColumn("piece", F.xxhash64("piece")))
    about = edges.where("gaps is not null").select("field_name", "shape_id", "weight", "gaps", "begins", "ends")
    # Strings without a gap are the first values known.
    pieces = edges.where(F.size("gaps") == 0).groupBy("field_name", "piece").agg(F.sum("weight").alias("mass"))
    fields = [r.field_name for r in about.select("field_name").distinct().collect()]
    inside = {field: [PRIOR] * KINDS for field in fields}

    def lattices() -> DataFrame:
        total = {r.field_name: r.mass for r in pieces.groupBy("field_name").agg(F.sum("mass").alias("mass")).collect()}
        rest = F.greatest(F.col("mass") - DISCOUNT, F.lit(0.0))
        share = F.coalesce(*[F.when(F.col("field_name") == f, rest / F.lit(t)) for f, t in total.items()], F.lit(0.0))
        known = edges.join(pieces.select("field_name", "piece", share.alias("share")), ["field_name", "piece"], "left")
        edge = F.struct("first", "last", "piece", F.coalesce("share", F.lit(0.0)).alias("share"))
        grouped = known.groupBy("field_name", "shape_id").agg(F.max("weight").alias("weight"), F.max("gaps").alias("gaps"), F.max("begins").alias("begins"), F.max("ends").alias("ends"), F.collect_list(edge).alias("edges"))
        columns = {name: F.col(f"edges.{one}") for name, one in (("firsts", "first"), ("lasts", "last"), ("shares", "share"), ("pieces", "piece"))}
        return grouped.withColumns(columns).drop("edges")

    for _ in range(rounds):
        mass = written(lattices().mapInPandas(_expected(inside), "field_name string, kind string, name long, mass double").groupBy("field_name", "kind", "name").agg(F.sum("mass").alias("mass")))
        seen: dict[tuple[str, str], dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for r in mass.where("kind != 'piece'").collect():  # at most two rows for each of the 72 kinds of gap of a field
            seen[r.field_name, r.kind][r.name] += r.mass
        for field in fields:
            for gap in range(KINDS):
                held, split = seen[field, "inside"][gap], seen[field, "between"][gap]
                share = (held + PRIOR * PRIOR_WEIGHT) / (held + split + PRIOR_WEIGHT)
                inside[field][gap] = min(max(share, 1e-6), 1 - 1e-6)
        pieces = mass.where("kind = 'piece'").select("field_name", F.col("name").alias("piece"), "mass")
    return lattices().mapInPandas(_best(inside), "field_name string, shape_id long, cuts array<array<int>>")


def split_values(rows: DataFrame, row_id: str, fields: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(row_id, field_name, pos, val): the values of every field that holds more than one."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])
    strings = rows.select(F.col(row_id).alias("row_id"), F.inline(pairs)).where(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) != "").withColumn("value", bare(F.col("value")))
    number = r"^\s*([0-9]{1,18})\s*(?:-|–|—|to)\s*([0-9]{1,18})\s*$"
    cuts = learned_cuts(strings.select("field_name", "value"), rounds)
    # Only shapes of several values, or of a range, have rows to give.
    single_range = r"^\s*[0-9]+\s*(?:-|–|—|to)\s*[0-9]+\s*[,;|/&\s]*$"
    salted = cuts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    maybe = strings.where(F.col("value").rlike(r"[\s,;|/&–—-]")).withColumn("shape", shape_of(F.col("value"))).withColumn("shape_id", _shape_id()).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALT)).cast("int"))
    cut = maybe.drop("shape").join(salted, ["field_name", "shape_id", "salt"]).where((F.size("cuts") > 1) | F.col("value").rlike(single_range))
    cut = cut.withColumn("tokens", F.regexp_extract_all("value", F.lit(TOKEN), F.lit(0)))
    unquoted = lambda p: F.trim(F.regexp_replace(F.regexp_extract(p, r'(?s)^"(.*)"$', 1), '""', '"'))
    unbracketed = lambda p: F.trim(F.regexp_replace(p, r"(?s)^(?:\[(.*)\]|\((.*)\)|\{(.*)\})$", "$1$2$3"))
    pieces = F.transform("cuts", lambda c: F.trim(F.array_join(F.slice("tokens", c[0] + 1, c[1] - c[0] + 1), "")))

    def value(p: Column) -> Column:
        low, high = (F.regexp_extract(p, number, g).try_cast("long") for g in (1, 2))
        spread = p.rlike(number) & (low <= high) & (high - low < WIDEST)
        text = F.when(p.rlike(r'(?s)^".*"$') & (F.length(p) > 1), unquoted(p)).otherwise(unbracketed(p))
        return F.struct(text.alias("text"), F.when(spread, low).alias("low"), F.when(spread, high).alias("high"))

    listed = cut.select("row_id", "field_name", F.filter(F.transform(pieces, value), lambda v: v["text"] != "").alias("vals"))
    listed = listed.where((F.size("vals") > 1) | F.exists("vals", lambda v: v["low"] < v["high"]))
    wide = F.exists("vals", lambda v: F.coalesce(v["high"] - v["low"] >= RANGE_WIDTH, F.lit(False)))
    narrow = lambda v: F.when(v["low"].isNotNull() & (v["high"] - v["low"] < RANGE_WIDTH), F.transform(F.sequence(v["low"], v["high"]), lambda n: n.cast("string"))).otherwise(F.array(v["text"]))
    few = listed.where(~wide).select("row_id", "field_name", F.posexplode(F.flatten(F.transform("vals", narrow))).alias("pos", "val")).withColumn("pos", (F.col("pos") + 1).cast("int"))
    return few.unionByName(_spread(listed.where(wide)))


def _spread(listed: DataFrame) -> DataFrame:
    """Values with wide ranges among them: positions are summed up, and a range is exploded block by block."""
    each = listed.select("row_id", "field_name", F.inline(F.transform("vals", lambda v, i: F.struct(i.alias("at"), v["text"].alias("text"), v["low"].alias("low"), F.coalesce(v["high"] - v["low"] + 1, F.lit(1)).alias("n")))))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("row_id", "field_name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = each.withColumn("before", before).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE_WIDTH).cast("long"))))
    rows = blocks.withColumn("k", F.explode(F.sequence("block", F.least(F.col("block") + RANGE_WIDTH, F.col("n")) - 1)))
    return rows.select("row_id", "field_name", (F.col("before") + F.col("k") + 1).cast("int").alias("pos"), F.coalesce((F.col("low") + F.col("k")).cast("string"), F.col("text")).alias("val"))
