"""Character spans: literal and stem search, BIO codes, overlap, clauses, contexts. Offsets count code points."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.functions import text as X
from lontar.functions.stem import stem, stems_of
from lontar.lexicons import CONNECTIVES, ROOTS, VERBAL_PREFIXES

_NO_LETTER_BEFORE, _NO_LETTER_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def normalize_aspect(name: Column) -> Column:
    """Trims, takes non-word characters off both ends, lower-cases, makes spaces single."""
    return F.regexp_replace(F.trim(F.lower(F.regexp_replace(F.trim(name), r"(?U)^[^\w]+|[^\w]+$", ""))), r"(?U)\s+", " ")


def python_normalize_aspect(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"^\W+|\W+$", "", name.strip()).lower().strip())


#: Pieces whose lengths are added up at a time. Growing arrays are copied, so short ones keep the work in proportion.
_BLOCK = 64


def _running(lengths: Column) -> Column:
    """Sums of the values before each one."""

    def before(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(values, first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")))["found"]

    total = lambda b: F.aggregate(b, F.lit(0), lambda s, n: s + n)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda k: F.slice(v, k * _BLOCK + 1, _BLOCK))
    return X.let(X.let(lengths, blocks), lambda bs: F.flatten(F.zip_with(bs, before(F.transform(bs, total), F.lit(0)), before)))


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut where a zero-width pattern matches: array of (start, piece, index); the first starts at 0."""
    return X.let(F.split(text, pattern), lambda p: F.zip_with(p, _running(F.transform(p, F.char_length)), lambda piece, at: F.struct(at.alias("start"), piece.alias("piece"))))


def literal_spans(docs: DataFrame, aspects: list[str], key: str = "doc_idx", text: str = "text") -> DataFrame:
    """key, aspect, start, end, surface of all occurrences, overlapping ones too, whole words and in any letter case.

    One regular expression cuts texts where an aspect's first word starts; what stands there meets the aspects with that
    first word in a hash join with the lexicon, which is a list at the driver.
    """
    names = sorted({n for a in aspects if (n := python_normalize_aspect(a))})
    if not names:
        return docs.select(key, F.lit(None).cast("string").alias("aspect"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("surface")).limit(0)
    head = lambda n: re.match(r"[^\W_]+|.", n)[0]
    pattern = r"(?iu)" + _NO_LETTER_BEFORE + "(?=(?:" + "|".join(re.escape(h) for h in sorted({head(n) for n in names})) + ")" + _NO_LETTER_AFTER + ")"
    longest = max(map(len, names)) + 1
    window = lambda p, i: F.substring(F.array_join(F.transform(F.slice(p, i + 1, longest), lambda x: x["piece"]), ""), 1, longest)
    found = X.let(_pieces(F.col(text), pattern), lambda p: F.transform(p, lambda s, i: F.struct(s["start"].alias("start"), window(p, i).alias("_w"))))
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.inline(found)).withColumn("_h", F.regexp_extract(F.lower("_w"), r"(?s)^(?:[\p{L}\p{N}]+|.)", 0))
    lexicon = docs.sparkSession.createDataFrame([(head(n), n, len(n)) for n in names], "_h string, aspect string, _n int")
    hits = rows.join(F.broadcast(lexicon), "_h").withColumn("surface", F.expr("substring(_w, 1, _n)"))
    kept = hits.filter((F.lower("surface") == F.col("aspect")) & ~F.expr("substring(_w, _n + 1, 1)").rlike(r"^[\p{L}\p{N}]"))
    return kept.select(key, "aspect", "start", (F.col("start") + F.col("_n")).alias("end"), "surface")


#: Where a run of word characters begins or ends; pieces between such places are words and gaps by turns.
_WORD_EDGE = r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)"


def word_spans(docs: DataFrame, key: str = "doc_idx", text: str = "text") -> DataFrame:
    """key, pos, start, end, word for each run of word characters. A text is cut where it stands, so nothing is shuffled."""
    words = F.filter(_pieces(F.coalesce(F.col(text), F.lit("")), _WORD_EDGE), lambda p: p["piece"].rlike(r"(?U)^\w"))
    flat = docs.select(key, F.posexplode(words).alias("pos", "_p"))
    return flat.select(key, F.col("_p.piece").alias("word"), F.col("_p.start").alias("start"), (F.col("_p.start") + F.char_length("_p.piece")).alias("end"), "pos")


#: Word characters as (?U)\\w has them, for Arrow's regular expressions: alphabetic ones, marks, digits, connectors, joiners.
_WORD_CLASS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}\x{200C}\x{200D}"
#: Texts that are cut into words at a time.
_TEXTS = 500


def _words(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """All words of texts, the gap before each, the text that each is in, and where it starts there."""
    cut = pc.split_pattern_regex(texts, f"[^{_WORD_CLASS}]+")
    words = cut.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy())[real]
    words = words.filter(pa.array(real))
    gaps = pc.split_pattern_regex(texts, f"[{_WORD_CLASS}]+")  # one more than there are words, the last behind them
    last = np.cumsum(gaps.value_lengths().to_numpy()) - 1
    before = np.ones(int(last[-1]) + 1 if len(last) else 0, bool)
    before[last] = False
    gaps = gaps.flatten().filter(pa.array(before))
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + pc.utf8_length(gaps).to_numpy(zero_copy_only=False))
    first = np.searchsorted(text, np.arange(len(texts)))
    base = np.concatenate([[0], ends])[first]
    return words, gaps, text, ends - sizes - base[text]


def _has_literal(low: str, aspect: str) -> bool:
    """Whether an aspect's text stands in a text in lower case, no letter or digit beside it."""
    at = low.find(aspect)
    while at >= 0:
        end = at + len(aspect)
        if not (at and low[at - 1].isalnum()) and not low[end : end + 1].isalnum():
            return True
        at = low.find(aspect, at + 1)
    return False


def _lower(text: str) -> str:
    """Each character in lower case, one for one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def stem_spans(docs: DataFrame, aspects: list[str], key: str = "doc_idx", text: str = "text", roots=ROOTS, unless_literal: bool = False) -> DataFrame:
    """Occurrences by stem: n words in a row whose stems are the aspect's, unless one is a verb formed from its word; with
    unless_literal, only of aspects that literal_spans does not find in the text.

    Texts are cut where they stand and only what is found becomes rows, so nothing is shuffled; a word is stemmed once a slice of
    texts at most, and seldom twice in a worker. The cost is the same whatever the lexicon."""
    names = list(dict.fromkeys(map(python_normalize_aspect, aspects)))
    parts_of = [p for a in names if (p := re.findall(r"\w+", a))]
    names = [a for a in names if re.search(r"\w", a)]
    if not names:
        return docs.select(key, F.lit("").alias("aspect"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("surface")).limit(0)
    chosen = frozenset(roots)
    grams: dict[tuple[str, ...], list[int]] = {}
    for i, parts in enumerate(parts_of):
        grams.setdefault(tuple(stem(p, chosen) for p in parts), []).append(i)
    wanted = {s: i for i, s in enumerate(sorted({s for gram in grams for s in gram}))}
    coded = {tuple(wanted[s] for s in gram): held for gram, held in grams.items()}
    lengths = sorted({len(gram) for gram in coded})

    def verbal(word: str, part: str) -> bool:
        low = word.lower()
        return any(low.startswith(p) and not part.startswith(p) for p in VERBAL_PREFIXES)

    def found(texts: pa.Array):
        """Text, aspect, start, end and surface of what is found in a slice of texts."""
        words, gaps, of, start = _words(texts)
        distinct = words.dictionary_encode()
        ids, forms = distinct.indices.to_numpy(), distinct.dictionary.to_pylist()
        codes = np.array([wanted.get(s, -1) for s in stems_of(forms, chosen)], np.int64)[ids] if len(ids) else ids
        hits = np.flatnonzero(codes >= 0)
        low: dict[int, str] = {}
        seen: dict[tuple[int, int], bool] = {}

        def literal(row: int, i: int) -> bool:
            if (row, i) not in seen:
                if row not in low:
                    low[row] = _lower(texts[row].as_py())
                seen[row, i] = _has_literal(low[row], names[i])
            return seen[row, i]

        known: dict[tuple, list[int]] = {}
        for n in lengths:
            at = hits[hits + n <= len(codes)]
            for k in range(1, n):
                at = at[(codes[at + k] >= 0) & (of[at + k] == of[at])]
            for place in at.tolist():
                run = ids[place] if n == 1 else tuple(ids[place : place + n].tolist())
                if run not in known:
                    those = coded.get(tuple(codes[place : place + n].tolist()), ())
                    known[run] = [i for i in those if not any(verbal(forms[w], p) for w, p in zip(ids[place : place + n], parts_of[i], strict=True))]
                for i in known[run]:
                    row = int(of[place])
                    if not (unless_literal and literal(row, i)):
                        surface = forms[ids[place]] + "".join(gaps[j].as_py() + forms[ids[j]] for j in range(place + 1, place + n))
                        yield row, i, int(start[place]), int(start[place]) + len(surface), surface

    held = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    schema = T.StructType([held.schema[key], T.StructField("aspect", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surface", T.StringType())])

    def task(batches):
        for batch in batches:
            for first in range(0, len(batch), _TEXTS):
                part = batch.slice(first, _TEXTS)
                row, i, start, end, surface = zip(*rows, strict=True) if (rows := list(found(part.column(1)))) else ((),) * 5
                columns = [pa.array([names[k] for k in i], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(surface, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), *columns], names=[key, "aspect", "start", "end", "surface"])

    return held.mapInArrow(task, schema)


def find_spans(docs: DataFrame, aspects: list[str], key: str = "doc_idx", text: str = "text", use_stemming: bool = True, roots=ROOTS) -> DataFrame:
    """Literal spans; for a document (a row) and aspect without any, spans by stem."""
    literal = literal_spans(docs, aspects, key, text).withColumn("match_type", F.lit("literal"))
    if not use_stemming:
        return literal
    return literal.unionByName(stem_spans(docs, aspects, key, text, roots, True).withColumn("match_type", F.lit("stem")))


def decode_bio(tags: DataFrame, key: str = "doc_idx", threshold: float | None = None) -> DataFrame:
    """Spans of BIO labels (0 O, 1 B, 2 I): key, first_pos, last_pos, start, end, confidence.

    tags: key, pos, label, start, end, conf. B opens, I goes on if one is open, O closes; tokens at (0, 0) are skipped.
    With a threshold, less sure tokens count as O and spans need that mean.
    """
    rows = tags.filter("NOT (start = 0 AND end = 0)")
    if threshold is not None:
        rows = rows.withColumn("label", F.when(F.col("conf") < threshold, 0).otherwise(F.col("label")))
    in_order = Window.partitionBy(key).orderBy("pos")
    island = rows.withColumn("_island", F.sum(F.when(F.col("label") != 2, 1).otherwise(0)).over(in_order))
    spans = island.filter("label != 0").groupBy(key, "_island").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.avg("conf").alias("confidence"), F.min_by("label", "pos").alias("_first"),
    )
    spans = spans.filter("_first = 1")
    return (spans.filter(F.col("confidence") >= threshold) if threshold is not None else spans).drop("_island", "_first")


def bio_tags(tokens: DataFrame, spans: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Labels of tokens (key, pos, start, end, special) by the aspect spans that hold them: first B, others I; special -100."""
    s = spans.select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_z"))
    held = tokens.join(s, (F.col(key) == F.col("_k")) & (F.col("start") >= F.col("_a")) & (F.col("end") <= F.col("_z")) & ~F.col("special"), "left")
    one = held.groupBy(key, "pos", "start", "end", "special").agg(F.min(F.struct("_a", "_z")).alias("_s"))
    first = F.min(F.when(F.col("_s._a").isNotNull(), F.col("pos"))).over(Window.partitionBy(key, "_s"))
    label = F.when(F.col("special"), -100).when(F.col("_s._a").isNull(), 0).when(F.col("pos") == first, 1).otherwise(2)
    return one.select(key, "pos", "start", "end", label.alias("label"))


def _token_labels(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of a document's spans in order, a token's is the first that holds it: the first that ends late enough, if it has begun."""
    labels = np.zeros(len(start), np.int32)
    if len(low) and len(start):
        at = np.searchsorted(np.maximum.accumulate(high), end)
        held = np.flatnonzero((at < len(low)) & (low[np.minimum(at, len(low) - 1)] <= start))
        labels[held] = 2
        labels[held[np.unique(at[held], return_index=True)[1]]] = 1
    return labels


def tagged_words(docs: DataFrame, spans: DataFrame, key: str = "doc_idx", text: str = "text") -> DataFrame:
    """key, tokens, labels: a document's words (word_spans) and their labels (bio_tags) as arrays. Its spans meet its text once, as a
    list, and words never leave it. Documents without a word are left out."""
    item = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    lists = spans.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    words = F.filter(_pieces(F.coalesce(F.col(text), F.lit("")), _WORD_EDGE), lambda p: p["piece"].rlike(r"(?U)^\w"))
    held = docs.select(key, text).join(lists, key, "left").select(key, F.coalesce("_s", F.array().cast("array<struct<start:int,end:int>>")).alias("_s"), words.alias("_p"))

    def task(batches):
        for batch in batches:
            kept, tokens, labels = [], [], []
            for i, (s, p) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                if len(p):
                    start = np.asarray(p.values.field("start"))
                    kept.append(i)
                    tokens.append(p.values.field("piece"))
                    labels.append(_token_labels(start, start + pc.utf8_length(tokens[-1]).to_numpy(), np.asarray(s.values.field("start")), np.asarray(s.values.field("end"))))
            ends = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
            words = pa.ListArray.from_arrays(ends, pa.concat_arrays(tokens) if tokens else pa.array([], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), words, pa.array(labels, pa.list_(pa.int32()))], names=[key, "tokens", "labels"])

    return held.mapInArrow(task, T.StructType([held.schema[key], T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.IntegerType()))]))


def iob_spans(tokens: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Character spans of IOB-labelled tokens (key, pos, token, label in B, I, O) in the text that single spaces join.

    An I without a span before it starts one. Returns key, start, end, surface.
    """
    in_order = Window.partitionBy(key).orderBy("pos")
    placed = tokens.withColumn("start", F.coalesce(F.sum(F.char_length("token") + 1).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    new = (F.col("label") == "B") | ((F.col("label") == "I") & (F.coalesce(F.lag("label").over(in_order), F.lit("O")) == "O"))
    island = placed.withColumn("_island", F.sum(new.cast("int")).over(in_order)).filter("label != 'O'")
    words = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return island.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.char_length("token")).alias("end"), F.array_join(F.transform(words, lambda w: w["token"]), " ").alias("surface")).drop("_island")


def resolve_overlaps(spans: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Greedy choice within each document: longest first, then earliest; what overlaps a chosen one goes.

    A span is no longer than those chosen before it, so it overlaps one only if its first or last place is taken: the time
    follows the number of spans and the text's length. A document's spans are held together.
    """
    item = F.struct((F.col("start") - F.col("end")).alias("n"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("aspect").alias("aspect"))
    held = spans.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    cut = lambda name: F.transform("_s", lambda s: s[name].cast("int"))
    flat = held.select(key, F.explode(F.arrays_zip("_s", _chosen(cut("start"), cut("end")).alias("kept"))).alias("z")).filter("z.kept")
    return flat.select(key, F.col("z._s.aspect").alias("aspect"), F.col("z._s.start").cast("int").alias("start"), F.col("z._s.end").cast("int").alias("end"))


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _chosen(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Of spans in order of falling length, those that overlap none chosen before. Empty ones overlap what they lie within."""
    out = []
    for a, b in zip(starts.to_pylist(), ends.to_pylist(), strict=True):
        least = min(a, default=0)
        owner, kept = np.zeros(max(b, default=0) - least + 1, np.int32), []
        for i, (start, end) in enumerate(zip(a, b, strict=True), 1):
            x, y = start - least, end - least
            free = (owner[x] == 0 and owner[y - 1] == 0) if x < y else x == 0 or owner[x] == 0 or owner[x - 1] != owner[x]
            if free:
                owner[x:y] = i
            kept.append(bool(free))
        out.append(kept)
    return pa.array(out, pa.list_(pa.bool_()))


def overlap_anti_join(candidates: DataFrame, taken: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Candidates that no taken span of their document overlaps: an equi-join on the document with a range condition."""
    t = taken.select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_z"))
    return candidates.join(t, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_z")) & (F.col("end") > F.col("_a")), "left_anti")


def _clause_edges(connectives) -> str:
    words = "|".join(re.escape(c) for c in connectives)
    return r"(?iu)(?<=[.!?;\n])|" + _NO_LETTER_BEFORE + f"(?=(?:{words})" + _NO_LETTER_AFTER + ")"


def clause_bounds(text: Column, connectives=CONNECTIVES) -> Column:
    """Where clauses of a text begin and end: after . ! ? ; newline, and before whole-word connectives."""
    return F.concat(F.transform(_pieces(text, _clause_edges(connectives)), lambda p: p["start"]), F.array(F.char_length(text)))


_RANGES = T.ArrayType(T.StructType().add("i", "integer").add("n", "integer").add("members", T.ArrayType(T.IntegerType())))


@F.arrow_udf(_RANGES)
def _clause_ranges(starts: pa.Array, ends: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """Which clauses, the i-th and n - 1 after it, spans touch, and the numbers of the spans that touch the same ones. i is null
    for spans without a place, or with one that is not in the text."""
    found = []
    for start, end, a, b in zip(starts, ends, low, high, strict=True):
        if a.values is None:  # a null text
            found.append([{"i": None, "n": 0, "members": list(range(len(start.values)))}])
            continue
        a, b = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
        start, end = (x.values.fill_null(-1).to_numpy(zero_copy_only=False) for x in (start, end))
        first = np.searchsorted(b, start, side="right")
        n = np.maximum(np.searchsorted(a, end, side="left") - first, 0)
        bad = (start < 0) | (end < 0) | (end > b[-1])
        first, n = np.where(bad, -1, first), np.where(bad, 0, n)
        groups: dict[tuple[int, int], list[int]] = {}
        for k, at in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
            groups.setdefault(at, []).append(k)
        found.append([{"i": None if i < 0 else i, "n": m, "members": held} for (i, m), held in groups.items()])
    return pa.array(found, pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int32()), ("members", pa.list_(pa.int32()))])))


def clause_groups(occurrences: DataFrame, docs: DataFrame, key: str = "doc_idx", text: str = "text", connectives=CONNECTIVES, carried: tuple[str, ...] = ()) -> DataFrame:
    """A row for each clause that occurrences stand in: `_clean`, the clause without what is at its edges, null for offsets out of
    range; `_members`, these occurrences' columns and `_fits`, whether the clause has more words than the span; `_text`; and
    `carried` columns of docs. A document's occurrences meet its text once, as a list, and its clauses are cut once and
    searched by place, so that the time follows the text and the number of occurrences."""
    columns = [c for c in occurrences.columns if c != key]
    lists = occurrences.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("_o"))
    cut = F.transform(_pieces(F.col("_text"), _clause_edges(connectives)), lambda p: F.struct(p["start"].alias("a"), (p["start"] + F.char_length(p["piece"])).alias("b"), p["piece"].alias("piece")))
    held = lists.join(docs.select(key, F.col(text).alias("_text"), *carried), key)
    held = held.select(key, "_text", *carried, "_o", F.inline(F.array(F.struct(cut.alias("_c")))))  # texts are cut behind the shuffle
    of = lambda c, name: F.transform(c, lambda x: x[name].cast("int"))
    ranges = _clause_ranges(of("_o", "start"), of("_o", "end"), of("_c", "a"), of("_c", "b"))
    flat = held.select(key, "_text", *carried, "_o", "_c", F.inline(ranges))
    words = "|".join(re.escape(c) for c in connectives)
    count = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    inner = F.slice("_c", F.col("i") + 1, F.col("n"))
    raw = F.array_join(F.transform(inner, lambda c: c["piece"]), "")
    clean = F.regexp_replace(F.regexp_replace(F.col("_r.raw"), r"^[ ,.;!?\n]+|[ ,.;!?\n]+$", ""), f"(?iu)^(?:{words}) [ ,]*", "")
    flat = flat.select(key, "_text", *carried, "_o", "members", F.inline(F.array(F.struct(F.struct(raw.alias("raw"), F.get("_c", F.col("i"))["a"].alias("at")).alias("_r")))))
    flat = flat.select(key, "_text", *carried, "_o", "members", "_r", F.inline(F.array(F.struct(clean.alias("_clean")))))
    flat = flat.select("*", F.inline(F.array(F.struct(count(F.col("_clean")).alias("_n")))))

    def member(k: Column) -> Column:
        span = lambda o: F.substring(F.col("_r.raw"), o["start"] - F.col("_r.at") + 1, o["end"] - o["start"])
        fits = lambda o: F.col("_clean").isNotNull() & (F.col("_n") > count(F.coalesce(span(o), F.lit(""))))
        return X.let(F.get("_o", k), lambda o: F.struct(*(o[c].alias(c) for c in columns), fits(o).alias("_fits")))

    return flat.select(key, "_text", *carried, "_clean", F.transform("members", member).alias("_members"))


def find_clauses(occurrences: DataFrame, docs: DataFrame, key: str = "doc_idx", text: str = "text", connectives=CONNECTIVES, carried: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences with `_piece`, the clause that holds [start, end), or null where it is the whole text; `_text`; and `carried`
    columns of docs."""
    columns = [c for c in occurrences.columns if c != key]
    flat = clause_groups(occurrences, docs, key, text, connectives, carried).select(key, "_text", *carried, "_clean", F.inline("_members"))
    return flat.select(key, *columns, "_text", *carried, F.when(F.col("_fits"), F.col("_clean")).alias("_piece"))


def add_clauses(occurrences: DataFrame, docs: DataFrame, key: str = "doc_idx", text: str = "text", connectives=CONNECTIVES) -> DataFrame:
    """Occurrences with `clause`, the one that holds [start, end), and `_text`. Bounds are found once for each document.

    A connective at its head goes. Offsets out of range, or a clause of no more words than the span, give the whole text.
    """
    return find_clauses(occurrences, docs, key, text, connectives).withColumn("clause", F.coalesce("_piece", "_text")).drop("_piece")


def context_words(aspect: Column, text: Column, window: int = 3) -> Column:
    """Words around the aspect's first occurrence as words; else the first 50 characters, all in lower case."""
    lowered = F.lower(text)

    def around(both: Column) -> Column:
        words, parts = both["words"], both["parts"]
        n, m = F.size(words), F.size(parts)
        fits = F.filter(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: (F.get(words, i - 1) == F.get(parts, F.lit(0))) & (F.slice(words, i, m) == parts))
        first = F.when((n >= m) & (m > 0), F.try_element_at(fits, F.lit(1)))
        low, high = (lambda at: F.greatest(F.lit(1), at - window)), (lambda at: F.least(n, at + m - 1 + window))
        return X.let(first, lambda at: F.when(at.isNotNull(), F.array_join(F.slice(words, low(at), high(at) - low(at) + 1), " ")))

    return F.coalesce(X.let(F.struct(X.tokens(lowered).alias("words"), X.tokens(F.lower(aspect)).alias("parts")), around), F.substring(lowered, 1, 50))


def char_context(text: Column, start: Column, end: Column, window: int = 30) -> Column:
    low = F.greatest(F.lit(0), start - window)
    return F.substring(text, low + 1, F.least(F.char_length(text), end + window) - low)
