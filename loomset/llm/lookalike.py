"""Problem 6: one consistent form for text that looks the same.

The text of an Arrow batch is copied once into a numpy array of code points.
Everything after that is array work over the whole batch: lookup-table gathers
for invisible characters, spaces, compatibility forms and look-alike letters,
expansion offsets where one character becomes several, and a vectorised
composition of combining marks.  No Python string operation runs per row.

Defined results

* null text stays null and is never a case; empty text is consistent.
* ASCII text (tab, line feed and carriage return included) is consistent.
* a look-alike letter is replaced inside a word that also holds Latin letters,
  and in a word made of nothing but look-alikes; a lone Greek letter or a word
  that has a letter without a Latin twin is a foreign word and stays.
* superscripts, subscripts, fractions and symbols stay.
* marks that have no composed form stay behind their letter, in canonical order.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 0x110000
#: Bytes of text handled at once; the arrays of a slice need about 60 times that.
SLICE_BYTES = 1 << 20

#: Letters of other scripts drawn like a Latin letter.
TWINS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԍ": "G", "ο": "o", "ν": "v",
    "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j", "ѵ": "v", "ɡ": "g", "ı": "i",
}
#: Punctuation drawn like an ASCII mark.
MARKS = {
    "‐": "-", "‑": "-", "−": "-", "‘": "'", "’": "'", "‛": "'", "ʼ": "'", "“": '"', "”": '"', "‟": '"',
    "․": ".", "﹐": ",", "∶": ":", "⁄": "/", "∕": "/",
}


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    count = np.ones(SIZE, np.uint8)
    start = np.arange(SIZE, dtype=np.int64)
    pool: list[int] = []

    def becomes(cp: int, text: str) -> None:
        count[cp] = len(text)
        start[cp] = SIZE + len(pool)
        pool.extend(map(ord, text))

    letter = np.zeros(SIZE, bool)
    latin = np.zeros(SIZE, bool)
    greek = np.zeros(SIZE, bool)
    ccc = np.zeros(SIZE, np.uint8)
    first: list[int] = []
    second: list[int] = []
    whole: list[int] = []
    for cp in range(SIZE):
        if 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or cp >= 0x20000:
            letter[cp] = 0x3400 <= cp <= 0xD7A3 and not 0xD800 <= cp
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        letter[cp] = cat[0] in "LM"
        ccc[cp] = unicodedata.combining(ch)
        dec = unicodedata.decomposition(ch)
        if cat[0] == "L":
            name = unicodedata.name(ch, "")
            latin[cp] = name.startswith(("LATIN", "FULLWIDTH LATIN")) and ch not in TWINS
            greek[cp] = name.startswith("GREEK")
        if cat == "Zs" and cp != 0x20:
            becomes(cp, " ")
        elif cat == "Cf" or cat == "Cc" and ch not in "\t\n\r" or 0xFE00 <= cp <= 0xFE0F or cp in (0x115F, 0x1160, 0x3164):
            becomes(cp, "")
        elif dec.startswith(("<wide>", "<narrow>", "<font>", "<circle>")) or dec.startswith("<compat>") and cat[0] == "L":
            if not dec.startswith("<circle>"):
                becomes(cp, unicodedata.normalize("NFKC", ch))
        elif dec and not dec.startswith("<") and " " in dec and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in dec.split())
            first.append(a), second.append(b), whole.append(cp)
        elif dec and not dec.startswith("<"):
            becomes(cp, unicodedata.normalize("NFC", ch))
    for odd, plain in MARKS.items():
        becomes(ord(odd), plain)
    twin = np.zeros(SIZE, np.uint32)
    for odd, plain in TWINS.items():
        twin[ord(odd)] = ord(plain)
    key = np.array(first, np.int64) << 21 | np.array(second, np.int64)
    order = np.argsort(key)
    split = np.zeros(SIZE, np.int64)
    split[whole] = key
    return {
        "count": count, "start": start, "flat": np.concatenate([np.arange(SIZE), pool]).astype(np.uint32),
        "letter": letter, "latin": latin, "greek": greek, "ccc": ccc, "twin": twin,
        "pair": key[order], "composed": np.array(whole, np.uint32)[order], "split": split,
    }


def _twins(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    twin = t["twin"][cp]
    if not twin.any():
        return cp
    letter = t["letter"][cp]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(begins)
    word = np.cumsum(begins) - 1
    base = letter & (t["ccc"][cp] == 0)
    at = np.where(letter, word, len(starts))
    total = lambda mask: np.bincount(at[mask], minlength=len(starts) + 1)
    letters, twins, latin, greek = total(base), total(base & (twin > 0)), total(t["latin"][cp]), total(base & t["greek"][cp])
    # A lone Greek letter is a symbol; a word made only of twins is a disguise.
    swap = (latin > 0) | (twins == letters) & ((letters > 1) | (greek == 0))
    swap[-1] = False
    return np.where((twin > 0) & swap[at], twin, cp)


def _loosen(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Take composed letters apart where a further mark follows, so that marks can be ordered."""
    while True:
        mark = t["ccc"][cp] > 0
        follows = np.zeros(len(cp), bool)
        follows[:-1] = mark[1:] & (row[1:] == row[:-1])
        at = np.flatnonzero(follows & (t["split"][cp] > 0))
        if not len(at):
            return cp, row
        pair = t["split"][cp[at]]
        cp = cp.copy()
        cp[at] = (pair >> 21).astype(np.uint32)
        cp, row = np.insert(cp, at + 1, (pair & 0x1FFFFF).astype(np.uint32)), np.insert(row, at + 1, row[at])


def _compose(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if t["ccc"][cp].any():
        cp, row = _loosen(cp, row, t)
    while True:
        ccc = t["ccc"][cp]
        if not ccc.any():
            return cp, row
        index = np.arange(len(cp))
        begins = ccc == 0
        begins[0] = True
        begins[1:] |= row[1:] != row[:-1]
        lead = np.maximum.accumulate(np.where(begins, index, 0))
        order = np.lexsort((ccc, lead))
        cp, ccc = cp[order], ccc[order]
        free = ccc > 0
        free[1:] &= (ccc[:-1] < ccc[1:]) | (lead[1:] == index[:-1])
        free &= lead != index
        at = np.flatnonzero(free)
        key = cp[lead[at]].astype(np.int64) << 21 | cp[at]
        place = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        hit = t["pair"][place] == key
        at, place = at[hit], place[hit]
        if not len(at):
            return cp, row
        _, once = np.unique(lead[at], return_index=True)
        at, place = at[once], place[once]
        cp = cp.copy()
        cp[lead[at]] = t["composed"][place]
        keep = np.ones(len(cp), bool)
        keep[at] = False
        cp, row = cp[keep], row[keep]


def _consistent_slice(text: pa.Array) -> pa.Array:
    t = _tables()
    rows = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + rows + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not len(raw) or raw.max() < 0x7F and raw.min() >= 0x20:
        return text
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    bounds = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets - offsets[0]]
    row = np.repeat(np.arange(rows), np.diff(bounds))
    count = t["count"][cp]
    if (count != 1).any() or (t["start"][cp] != cp).any():
        source = np.repeat(np.arange(len(cp)), count)
        ends = np.cumsum(count, dtype=np.int64)
        within = np.arange(len(source)) - np.repeat(ends - count, count)
        cp, row = t["flat"][t["start"][cp[source]] + within], row[source]
    if len(cp):
        cp, row = _compose(_twins(cp, row, t), row, t)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    sizes = np.bincount(row, weights=width, minlength=rows).astype(np.int64)
    out = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(at.tobytes()), pa.py_buffer(out))


def consistent(text: pa.Array) -> pa.Array:
    """The consistent form of every string of an Arrow array; nulls stay null."""
    text = text.cast(pa.large_string())
    filled = pc.fill_null(text, "") if text.null_count else text
    done: list[pa.Array] = []
    sizes = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(filled):
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
        done.append(_consistent_slice(filled.slice(begin, end - begin)))
        begin = end
    out = pa.concat_arrays(done) if done else filled
    return pc.if_else(pc.is_valid(text), out, pa.scalar(None, pa.large_string())) if text.null_count else out


def consistent_text(df: DataFrame, column: str, into: str = "consistent", changed: str = "changed") -> DataFrame:
    """``df`` with the consistent form of ``column`` and a flag where it differs.

    Columns of ``df`` that already bear the new names are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (into, changed)]
    schema = T.StructType([*kept, T.StructField(into, T.StringType()), T.StructField(changed, T.BooleanType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(column))
            new = consistent(text)
            differs = pc.fill_null(pc.not_equal(text.cast(pa.large_string()), new), False)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [new.cast(pa.string()), differs], names=[*names, into, changed])

    return df.mapInArrow(run, schema)


def inconsistent_records(df: DataFrame, field_name: str, column: str, record: str) -> DataFrame:
    """(field_name, record_id) of the rows whose ``column`` isn't in the consistent form.

    Plain ASCII is consistent by definition, so the JVM filters it before Python.
    """
    odd = df.where(F.col(column).rlike(r"[^\t\n\r -~]")).select(F.col(record).cast("string").alias("record_id"), F.col(column).alias("text"))
    found = consistent_text(odd, "text").where("changed")
    return found.select(F.lit(field_name).alias("field_name"), "record_id").distinct()
