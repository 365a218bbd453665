"""Many terms at once: one Aho-Corasick automaton over normalised texts, with a map back to the texts' offsets.

A term's words may stand apart by any white space, letters match in any case, and no word character stands before or after.
The time for a text follows its length and its hits, not the number of terms.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"\s+")
#: Letters that count as `i` beside those whose simple case folding says so.
_I = {"İ": "i", "ı": "i"}
_FOUND = "array<struct<term:int,start:int,end:int>>"


def fold(text: str) -> str:
    """Each character in folded case, one for one."""
    low = text.lower()
    if text.isascii():
        return low
    return "".join(f if len(f := _I.get(c) or c.casefold()) == 1 else x if len(x := c.lower()) == 1 else c for c in text)


def normalised(text: str) -> tuple[str, list[int], list[int]]:
    """The folded text with single spaces for runs of white space, and where, in it, how many characters more lie before."""
    out, at, shift, places, shifts = [], 0, 0, [0], [0]
    for m in _SPACE.finditer(text):
        a, b = m.span()
        if b - a > 1:
            shift += b - a - 1
            places.append(b - shift)
            shifts.append(shift)
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return fold(" ".join(out)), places, shifts


def _word(c: str) -> bool:
    return c == "_" or c.isalnum()


class Terms:
    """Finds terms; a term's own matches do not overlap, those of different terms may."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            if name := fold(" ".join(term.split())):
                held.setdefault(name, []).append(i)
        for name, ids in held.items():
            self.automaton.add_word(name, (len(name), ids))
        self.any = bool(held)
        if self.any:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        if not self.any or not text:
            return []
        whole, places, shifts = normalised(text)
        back = (lambda i: i) if len(places) == 1 else (lambda i: i + shifts[bisect_right(places, i) - 1])
        out, ends = [], {}
        for last, (n, ids) in self.automaton.iter(whole):
            a, b = last - n + 1, last + 1
            if (a and _word(whole[a - 1])) or (b < len(whole) and _word(whole[b])) or a < ends.get(ids[0], 0):
                continue
            ends[ids[0]] = b
            start, end = back(a), back(last) + 1
            out += [(i, start, end) for i in ids]
        return out


def term_spans(docs: DataFrame, terms: list[str], key: str = "doc_idx", text: str = "text") -> DataFrame:
    """key, aspect, start, end, surface of all occurrences of the terms, which are a list at the driver.

    aspect is the term as given; terms without a word occur nowhere, null texts hold none, and a term given twice counts once.
    """
    names = list(dict.fromkeys(terms))

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        known = _known(names)
        return pa.array([[{"term": i, "start": a, "end": b} for i, a, b in known.find(t.as_py() or "")] for t in texts], pa.list_(pa.struct([("term", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))

    table = docs.sparkSession.createDataFrame(list(enumerate(names)), "term int, aspect string")
    hits = docs.withColumn("_found", found(text)).filter(F.size("_found") > 0).select(key, text, F.explode("_found").alias("f"))
    placed = hits.select(key, F.expr(f"substring({text}, f.start + 1, f.end - f.start)").alias("surface"), "f.*")
    return placed.join(table, "term").select(key, "aspect", "start", "end", "surface")


_LAST: dict = {}


def _known(names: list[str]) -> Terms:
    """The automaton of a worker: built once for a list of terms, and kept until another list comes."""
    if _LAST.get("names") != names:
        _LAST.update(names=names, terms=Terms(names))
    return _LAST["terms"]
