"""A confix-stripping stemmer of the Nazief-Adriani family, with the enhanced rules; the root dictionary is an input.

Tables of words are stemmed by their distinct values; lists of words where they stand, each distinct word once a batch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.lexicons import ROOTS

# FIXED VALUES from the published tables of the method, as they decide what a stem is.
PARTICLES, POSSESSIVES, SUFFIXES = ("lah", "kah", "tah", "pun"), ("ku", "mu", "nya"), ("kan", "an", "i")
#: Prefixes that change no letter.
PLAIN_PREFIXES = ("di", "ke", "se", "ku", "kau")
#: Pairs of a word's outer prefix and its suffix that the language doesn't form.
DISALLOWED = {("be", "i"), ("di", "an"), ("ke", "i"), ("ke", "kan"), ("me", "an"), ("se", "i"), ("se", "kan"), ("te", "an")}
#: Words of these shapes lose their prefix before their suffix.
PREFIX_FIRST = r"be.+lah|be.+an|me.+i|di.+i|pe.+i|ter.+i"
#: Number, shape and what may be left, in the order of the tables; V is a vowel, C a consonant, A any letter.
PREFIX_RULES = (
    (1, "ber(V.*)", (r"\1", r"r\1")),
    (2, "ber((?!r)CA(?!er).*)", (r"\1",)),
    (3, "ber((?!r)CAerV.*)", (r"\1",)),
    (4, "bel(ajar)", (r"\1",)),
    (5, "be((?![rl])CerC.*)", (r"\1",)),
    (6, "ter(V.*)", (r"\1", r"r\1")),
    (7, "ter((?!r)CerV.*)", (r"\1",)),
    (8, "ter((?!r)C(?!er).*)", (r"\1",)),
    (9, "te((?!r)CerC.*)", (r"\1",)),
    (10, "me([lrwy]V.*)", (r"\1",)),
    (11, "mem([bfv].*)", (r"\1",)),
    (12, "mem(pe.*)", (r"\1",)),
    (13, "mem(r?V.*)", (r"m\1", r"p\1")),
    (14, "men([cdjstz].*)", (r"\1",)),
    (15, "men(V.*)", (r"n\1", r"t\1")),
    (16, "meng([ghqk].*)", (r"\1",)),
    (17, "meng(e?)(.+)", (r"\1\2", r"k\1\2", r"\2", r"ng\1\2")),
    (18, "meny(V.*)", (r"s\1", r"ny\1")),
    (19, "mem(p[^e].*)", (r"\1",)),
    (20, "pe([wy]V.*)", (r"\1",)),
    (21, "per(V.*)", (r"\1", r"r\1")),
    (23, "per((?!r)CA(?!er).*)", (r"\1",)),
    (24, "per((?!r)CAerV.*)", (r"\1",)),
    (25, "pem([bfv].*)", (r"\1",)),
    (26, "pem(r?V.*)", (r"m\1", r"p\1")),
    (27, "pen([cdjstz].*)", (r"\1",)),
    (28, "pen(V.*)", (r"n\1", r"t\1")),
    (29, "peng([ghqk].*)", (r"\1",)),
    (30, "peng(e?)(.+)", (r"\1\2", r"k\1\2", r"\2", r"ng\1\2")),
    (31, "peny(V.*)", (r"s\1", r"ny\1")),
    (32, "pe(lV.*)", (r"\1",)),
    (33, "pe(?![rwylmn])C(erV.*)", (r"\1",)),
    (34, "pe((?![rwylmn])C(?!er).*)", (r"\1",)),
    (35, "ter((?!r)CerC.*)", (r"\1",)),
    (36, "pe((?![rwylmn])CerC.*)", (r"\1",)),
)
#: The shortest form of rule 4 for nouns, and infixes: what is left drops the infix.
SPECIAL_RULES = ((32, "pel(ajar)", (r"\1",)),)
INFIX_RULES = ((37, "(C)er(V.*)", (r"\1\2",)), (38, "(C)el(V.*)", (r"\1\2",)), (39, "(C)em(V.*)", (r"\1\2",)), (40, "(C)in(V.*)", (r"\1\2",)))
# End of fixed values.


def _compiled(rules):
    shape = lambda s: s.replace("V", "[aiueo]").replace("C", "[bcdfghjklmnpqrstvwxyz]").replace("A", "[a-z]")
    return [(number, re.compile(shape(pattern)), left) for number, pattern, left in rules]


_PREFIXES = {head: _compiled(r for r in SPECIAL_RULES + PREFIX_RULES if r[1].startswith(head)) for head in ("be", "te", "me", "pe")}
_INFIXES, _FIRST = _compiled(INFIX_RULES), re.compile(PREFIX_FIRST)
_ENCLITIC, _MOST_PREFIXES = re.compile("-(?:" + "|".join(PARTICLES + POSSESSIVES) + ")$"), 3


def _without_prefix(word: str):
    """(kind, rule, what is left) of the outermost prefix: first the forms of the rule that fits, then of those after it."""
    for p in PLAIN_PREFIXES:
        if word.startswith(p):
            yield p, p, word[len(p) :]
    for rule, pattern, lefts in _PREFIXES.get(word[:2], ()):
        if m := pattern.fullmatch(word):
            for left in lefts:
                yield word[:2], rule, m.expand(left)


def _search(word: str, suffix: str, finish, outer: str = "", last: str = "", depth: int = 0):
    """Takes up to three prefixes off, no two alike in a row, and goes back to the next form where one leads to no root."""
    if depth == _MOST_PREFIXES:
        return None
    forms = [f for f in _without_prefix(word) if len(f[2]) >= 2 and f[0] != last and (outer or f[0], suffix) not in DISALLOWED]
    for kind, rule, left in forms:
        if root := finish(left, outer or kind):
            return root[0], (rule, *root[1])
    for kind, rule, left in forms:
        if deeper := _search(left, suffix, finish, outer or kind, kind, depth + 1):
            return deeper[0], (rule, *deeper[1])
    return None


def _suffix_chain(word: str):
    """(form, suffixes off, derivational suffix) from the word on, one more suffix off each time, outermost first."""
    chain = [(word, (), "")]
    for kind, endings in enumerate((PARTICLES, POSSESSIVES, SUFFIXES)):
        form, off, _ = chain[-1]
        if ending := next((e for e in endings if form.endswith(e) and len(form) - len(e) >= 3), None):
            if kind == 2 and ending == "kan":  # the k may belong to the root, with -an after it
                chain.append((form[:-2], (*off, "an"), "an"))
            chain.append((form[: -len(ending)], (*off, ending), ending if kind == 2 else ""))
    return chain


def _root(word: str, roots):
    """The root and the affixes and rules that led to it, or None."""
    chain = _suffix_chain(word)

    def known(form, _):
        if form in roots:
            return form, ()
        return next(((m.expand(left[0]), (rule,)) for rule, p, left in _INFIXES if (m := p.fullmatch(form)) and m.expand(left[0]) in roots), None)

    def with_suffixes(form, outer):
        for left, off, suffix in _suffix_chain(form):
            if left in roots and (outer, suffix) not in DISALLOWED:
                return left, off
        return None

    if _FIRST.fullmatch(word) and (found := _search(word, "", with_suffixes)):
        return found
    for form, off, _ in sorted(chain, key=lambda c: c[2] == "an" and c is not chain[-1]):  # -kan before -an
        if form in roots:
            return form, off
    for form, off, suffix in reversed(chain):  # all suffixes off, then the innermost back, one at a time
        if found := _search(form, suffix, known):
            return found[0], (*off, *found[1])
    for form, off, _ in reversed(chain):
        if found := known(form, None):
            return found[0], (*off, *found[1])
    return None


def explain(word: str, roots=ROOTS) -> tuple[str, tuple]:
    """The stem, and the suffixes, plain prefixes and rule numbers that led to it: suffixes first, unless the word's shape is
    one that loses its prefix first. A word that leads to no root has no steps."""
    plain = "".join(c for c in word.lower() if c.isalnum() or c == "-").strip("-")
    if len(plain) <= 3 or plain in roots:
        return plain, ()
    if "-" in plain:
        return _of_halves(plain, roots)
    return _root(plain, roots) or (plain, ())


def _of_halves(word: str, roots) -> tuple[str, tuple]:
    """A doubled word has its halves' common root; the second half may lack the nasal prefix of the first."""
    body = _ENCLITIC.sub("", word)
    if body.count("-") != 1:
        found = _root(body, roots) if "-" not in body else None
        return (body, ()) if body in roots else found or (word, ())
    first, second = body.split("-")
    (a, steps), (b, _) = explain(first, roots), explain(second, roots)
    if a != b and b not in roots:
        b = explain("me" + second, roots)[0]
    return (a, ("doubled", *steps)) if a == b else (word, ())


def stem(word: str, roots=ROOTS) -> str:
    """Root of a word if taking affixes off finds one, else the word without what is not a letter or digit."""
    return explain(word, roots)[0]


def stem_udf(roots=ROOTS):
    chosen = frozenset(roots)

    def run(words: pa.Array) -> pa.Array:
        return pa.array([w if w is None else stem(w, chosen) for w in words.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


#: Words whose stems a task remembers; it starts anew beyond that.
REMEMBERED = 300_000


_LAST: dict = {}


def stems_of(words: list[str], roots: frozenset[str]) -> list[str]:
    """The words' stems. A worker remembers them until other roots come."""
    if _LAST.get("roots") != roots:
        _LAST.update(roots=roots, known={})
    known = _LAST["known"]
    if len(known) > REMEMBERED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = stem(w, roots)
    return [known[w] for w in words]


def stem_lists_udf(roots=ROOTS):
    """Arrays of words to arrays of their stems; a null array becomes an empty one. Batches are coded as dictionaries, so a word
    is stemmed once a batch at most, and seldom twice in a task."""
    chosen, known = frozenset(roots), {}

    def run(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        if len(known) > REMEMBERED:
            known.clear()
        found = []
        for w in coded.dictionary.to_pylist():
            if w not in known:
                known[w] = stem(w, chosen)
            found.append(known[w])
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.string()).take(coded.indices))

    return F.arrow_udf(run, "array<string>")


def stem_map(tokens: DataFrame, column: str, roots=ROOTS) -> DataFrame:
    """token, stem for the distinct values of a column, which are dealt over all cores: they are few bytes, but much work."""
    distinct = tokens.select(F.col(column).alias("token")).filter("token is not null").distinct()
    return distinct.repartition(2 * tokens.sparkSession.sparkContext.defaultParallelism).withColumn("stem", stem_udf(roots)("token"))


def prefix_class(surface: Column, root: Column, prefixes) -> Column:
    """First prefix that the surface has and the stem hasn't; empty if they are equal or none fits."""
    found = F.coalesce(*(F.when(surface.startswith(p) & ~root.startswith(p), F.lit(p)) for p in prefixes), F.lit(""))
    return F.when(surface == root, F.lit("")).otherwise(found)
