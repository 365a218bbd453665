"""Text steps as Column expressions. Java's \\w, \\s and \\b are ASCII unless (?U) is set; the patterns set it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- FIXED VALUES: what counts as a link's tail and as an emoji decides results ----------------------------------------
_URL_TAIL = r"(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
# ---- end of fixed values ----------------------------------------------------------------------------------------------
_RUN = r"([a-zA-Z])\1{2,}"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it; Catalyst doesn't inline it."""
    return F.get(F.transform(F.array(value), body), 0)


def _where(text: Column, present, pattern: str, target: str = "") -> Column:
    """Replaces a pattern in texts that a cheap test finds it possible for; most texts hold none."""
    return let(text, lambda t: F.when(present(t), F.regexp_replace(t, pattern, target)).otherwise(t))


def no_urls(text: Column) -> Column:
    """The class `[$-_...]` holds the range $ to _, so it takes digits, capitals and / : ? = < > ; too."""
    return _where(_where(text, lambda t: t.contains("http"), "http[s]?://" + _URL_TAIL), lambda t: t.contains("www."), r"www\." + _URL_TAIL)


def no_emails(text: Column) -> Column:
    return _where(text, lambda t: t.contains("@"), r"(?U)\S+@\S+")


def no_mentions(text: Column) -> Column:
    """Mentions and the RT mark; RT is not bound to words, so "SMART phone" loses its RT."""
    return _where(text, lambda t: t.contains("@") | t.contains("RT"), r"(?U)@\w+|RT\s+")


def no_hash_signs(text: Column) -> Column:
    return _where(text, lambda t: t.contains("#"), r"(?U)#(\w+)", "$1")


def no_emoji(text: Column) -> Column:
    return _where(text, lambda t: F.octet_length(t) > F.char_length(t), _EMOJI)


def latin_only(text: Column, keep_punctuation: bool = False) -> Column:
    return F.regexp_replace(text, r"(?U)[^a-zA-Z0-9\s" + (r".,!?" if keep_punctuation else "") + "]", " ")


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def squeeze_letters(text: Column, roots: frozenset[str] = frozenset()) -> Column:
    """Runs of three or more of one letter become one, or two if the word (between spaces) is a known root then.

    A run is judged with the word's other runs as they stand, and no root holds a run, so only a word's single run can
    become two letters."""
    single = lambda t: F.regexp_replace(t, _RUN, "$1")
    if not roots:
        return single(text)
    known = sorted({r for r in roots if re.search(r"([a-z])\1", r)})

    def word(w: Column) -> Column:
        return let(F.regexp_replace(w, _RUN, "$1$1"), lambda d: F.when(F.lower(d).isin(*known) & (F.regexp_count(w, F.lit(_RUN)) == 1), d).otherwise(single(w)))

    squeezed = lambda t: F.array_join(F.transform(F.split(t, " "), lambda w: F.when(w.rlike(_RUN), word(w)).otherwise(w)), " ")
    return let(text, lambda t: F.when(t.rlike(_RUN), squeezed(t)).otherwise(t)) if known else single(text)


def tokens(text: Column) -> Column:
    """Split at white space; no empty tokens, so blank texts give an empty array."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def map_tokens(words: Column, pairs: dict[str, str]) -> Column:
    """Looks each token up once; an empty value drops it, one of several words becomes several tokens.

    A hash set tells which tokens have an entry, so a long dictionary costs no more than a short one where none has."""
    if not pairs:
        return words
    values = {k: " ".join(v.split()) for k, v in pairs.items()}
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    mapped = F.transform(words, lambda t: F.when(t.isin(*values), F.element_at(table, t)).otherwise(t))
    if all(v and " " not in v for v in values.values()):
        return mapped
    return F.array_remove(F.split(F.array_join(mapped, " "), " "), "")


def replace_phrases(text: Column, pairs: dict[str, str]) -> Column:
    """Keys with a space, on the whole text and at word boundaries."""
    for phrase, target in pairs.items():
        if " " in phrase:
            text = _where(text, lambda t, p=phrase: t.contains(p), r"(?U)\b" + re.escape(phrase) + r"\b", target.replace("\\", r"\\").replace("$", r"\$"))
    return text


def without(words: Column, dropped) -> Column:
    """Keeps repeats, unlike array_except."""
    chosen = sorted(dropped)
    return words if not chosen else F.filter(words, lambda t: ~t.isin(*chosen))


def min_length(words: Column, n: int) -> Column:
    return words if n <= 1 else F.filter(words, lambda t: F.char_length(t) >= n)


def no_adjacent_repeats(words: Column) -> Column:
    return let(words, lambda w: F.filter(w, lambda t, i: (i == 0) | ~t.eqNullSafe(F.get(w, i - 1))))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp((x - top) / F.lit(float(temperature))))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def exact_round(x: Column, digits: int) -> Column:
    """Rounds the exact binary value, half to even, as decimal formatting does."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")
