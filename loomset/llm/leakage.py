"""Problem 8: evaluation passages inside training documents.

Size-partitioned MinHash containment search.  What leaks is a passage: a window
of ``RUN`` running words of a test item, that is a small set of word shingles.
The search asks for the sets that contain it.  These are pieces of documents,
at most ``PIECE`` shingles each, which overlap so that every window of a text
lies inside one of its pieces.

Pieces are partitioned by the size of their sets.  A window of q shingles inside
a piece of u has containment 1 and hence a Jaccard similarity of q / u, so each
partition has its own threshold, and its own number of signature bands (one
MinHash each) by which a window is missed with a chance below ``MISS``: one band
where the sizes are equal, thirty at twice the size.

A piece that shares a band with a window of an item is a candidate for that
item, and is verified exactly: a run of ``RUN`` words of the item must stand in
it.  The few pieces that repeat a shingle, whose windows may be so small that
they need more bands, are all verified.  For the leaks that are left the
containment of the whole item is computed.

The test items are the query set.  They go in blocks of at most ``QUERY_WORDS``
words to the workers, each block against all documents; documents are read, cut
and searched where they lie, and nothing of them is shuffled before the leaks.

Defined results: words are runs of letters and digits in lower case; null or
short texts (fewer than ``RUN`` words) leak nothing and contain nothing;
repeated rows give a pair once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.session import written

RUN = 12
SHINGLE = 5
#: Shingles of a window, and of a piece at most; the next piece begins so many shingles later.
WINDOW, PIECE = RUN - SHINGLE + 1, 16
STEP = PIECE - WINDOW + 1
#: Chance that the bands of a partition miss a window.
MISS = 1e-9
#: Words of the test items in one pass over the documents, unless one item alone is longer.
QUERY_WORDS = 300_000
#: Pieces handled at once.
SLICE = 50_000

_PRIME, _MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: Column) -> Column:
    """The 64-bit hashes of the words of a text, in their order."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX
    x = (x ^ x >> np.uint64(27)) * _LAST
    return x ^ x >> np.uint64(31)


def _grams(code: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    count = max(0, len(code) - size + 1)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = total * _PRIME + code[k : k + count]
    return _mixed(total)


def _least(shingles: np.ndarray, band: int) -> np.ndarray:
    """The MinHash of every column of shingles under the permutation of a band."""
    return ((shingles ^ _mixed(np.uint64([band + 1]))) * (_mixed(np.uint64([band + 101])) | np.uint64(1))).min(axis=0)


def bands_needed(size: np.ndarray) -> np.ndarray:
    """Bands for sets of so many shingles that hold a window."""
    return np.ceil(math.log(MISS) / np.log1p(-np.minimum(WINDOW / size, 1 - MISS))).astype(int)


class Queries:
    """A block of test items: the band signatures of their windows, and their runs and shingles for the exact check."""

    def __init__(self, items: list[tuple[object, np.ndarray]]) -> None:
        self.keys = [key for key, _ in items]
        self.shingles = [np.unique(_grams(code, SHINGLE)) for _, code in items]
        most = int(bands_needed(np.array([PIECE]))[0])
        signs, runs = [], []
        for number, (_, code) in enumerate(items):
            shingles, run = _grams(code, SHINGLE), np.unique(_grams(code, RUN))
            windows = np.lib.stride_tricks.sliding_window_view(shingles, WINDOW) if len(shingles) >= WINDOW else np.empty((0, WINDOW), np.uint64)
            own = [np.unique(_least(windows.T, band)) for band in range(most)] if len(windows) else []
            signs += [(sign, number) for sign in own]
            runs.append((run, number))
        self.sign, self.sign_item = self._sorted(signs)
        self.run, self.run_item = self._sorted(runs)
        # Most signatures of documents are none of these; a table of their leading bits says so at once.
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.sign >> np.uint64(42)] = True

    @staticmethod
    def _sorted(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        value = np.concatenate([np.empty(0, np.uint64), *[p for p, _ in parts]])
        item = np.concatenate([np.empty(0, np.int64), *[np.full(len(p), n) for p, n in parts]])
        order = np.argsort(value, kind="stable")
        return value[order], item[order]

    def _pairs(self, value: np.ndarray, place: np.ndarray, known: np.ndarray, item: np.ndarray) -> np.ndarray:
        """place * items + item for every item that a value is known of."""
        low, high = np.searchsorted(known, value, "left"), np.searchsorted(known, value, "right")
        count = high - low
        at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.unique(np.repeat(place, count) * len(self.keys) + item[at])

    def bands(self, shingles: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The signatures of pieces that items share, the piece of each, and the pieces that repeat a shingle."""
        # Places beyond the end of a piece repeat its last shingle, which changes no minimum.
        rows = shingles[np.minimum(start + np.arange(PIECE)[:, None], end - 1)]
        inside, same = np.arange(PIECE)[:, None] < end - start, np.zeros(len(start), bool)
        for lag in range(1, PIECE):
            same |= ((rows[lag:] == rows[:-lag]) & inside[lag:]).any(axis=0)
        repeating = np.flatnonzero(same)
        need = bands_needed(end - start)
        value, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for band in range(need.max(initial=0)):
            own = np.flatnonzero(need > band)
            sign = _least(rows if len(own) == len(start) else rows[:, own], band)
            hit = np.flatnonzero(self.seen[sign >> np.uint64(42)])
            hit = hit[self.sign[np.minimum(np.searchsorted(self.sign, sign[hit]), len(self.sign) - 1)] == sign[hit]]
            value.append(sign[hit]), place.append(own[hit])
        return np.concatenate(value), np.concatenate(place), repeating

    def search(self, code: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float]]:
        """(text, item, containment) of the leaks; text n has the words from ``bounds[n]`` to before ``bounds[n + 1]``."""
        if not len(self.sign):
            return []
        width = len(self.keys)
        shingles = _grams(code, SHINGLE)
        counts = np.maximum(0, np.diff(bounds) - SHINGLE + 1)
        pieces = np.where(counts >= WINDOW, (counts - WINDOW) // STEP + 1, 0)
        text = np.repeat(np.arange(len(counts)), pieces)
        start = bounds[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(start + PIECE, bounds[text] + counts[text])
        found = [np.empty(0, np.int64)]
        for begin in range(0, len(text), SLICE):
            part = slice(begin, begin + SLICE)
            value, place, repeating = self.bands(shingles, start[part], end[part])
            # The exact check: a run of the candidate's words in the piece.
            piece = np.union1d(place, repeating)
            first, size = start[part][piece], (end - start)[part][piece] - WINDOW + 1
            at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            exact = self._pairs(_grams_at(code, at, RUN), np.repeat(piece, size), self.run, self.run_item)
            held = np.isin(place, exact // width)
            near = self._pairs(value[held], place[held], self.sign, self.sign_item)
            both = exact[np.isin(exact, near) | np.isin(exact // width, repeating)]
            found.append(text[part][both // width] * width + both % width)
        share = lambda n, i: np.isin(self.shingles[i], shingles[bounds[n] : bounds[n] + counts[n]]).mean()
        return [(int(n), int(i), float(share(n, i))) for n, i in (divmod(x, width) for x in np.unique(np.concatenate(found)))]


def _grams_at(code: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total = total * _PRIME + code[at + k]
    return _mixed(total)


def _searched(documents: DataFrame, queries: Queries, doc_type: T.DataType, item_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", item_type), T.StructField("containment", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(1)
            offsets = listed.offsets.to_numpy().astype(np.int64)
            code = listed.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            leaked = queries.search(code, offsets - offsets[0])
            doc = batch.column(0).take(pa.array([n for n, _, _ in leaked], pa.int64()))
            item = pa.array([queries.keys[i] for _, i, _ in leaked], type=_arrow(item_type))
            yield pa.RecordBatch.from_arrays([doc, item, pa.array([c for _, _, c in leaked], pa.float64())], names=schema.names)

    return documents.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _blocks(items: DataFrame) -> Iterator[Queries]:
    """The test items with a run of words, in blocks of bounded length."""
    block, filled = [], 0
    for row in items.where(F.size("words") >= RUN).toLocalIterator():
        if block and filled + len(row.words) > QUERY_WORDS:
            yield Queries(block)
            block, filled = [], 0
        block.append((row.item_id, np.array(row.words, np.int64).view(np.uint64)))
        filled += len(row.words)
    yield Queries(block)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, containment): documents that hold a run of an item's words.

    ``containment`` is the share of the item's word shingles that the document holds.
    """
    cut = documents.where(F.col("text").isNotNull()).select("doc_id", words(F.col("text")).alias("words"))
    asked = items.where(F.col("text").isNotNull()).select("item_id", words(F.col("text")).alias("words"))
    kinds = documents.schema["doc_id"].dataType, items.schema["item_id"].dataType
    passes: list[DataFrame] = []
    for queries in _blocks(asked):
        # Another block: the last pass is done first, so that the driver holds one block at a time.
        passes[-1:] = [written(p) for p in passes[-1:]]
        passes.append(_searched(cut, queries, *kinds))
    found = reduce(DataFrame.unionByName, passes)
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))
