"""Three-class sentiment: the negation-aware lexicon scorer, the model boundary, and what is reported of predictions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.config import CleanConfig, Lexicon, SentimentConfig
from lontar.functions import text as X
from lontar.lexicons import INDONESIAN
from lontar.operators.clean import clean

LABELS = ("positive", "neutral", "negative")
#: What is taken off a token's ends, and how many tokens a negation reaches.
EDGE = '.,!?;:"()[]'
SCOPE = 2

#: Other names that models give the labels.
ALIASES = {
    "positive": ("positive", "positif", "pos", "label_positive"),
    "neutral": ("neutral", "netral", "neu", "label_neutral"),
    "negative": ("negative", "negatif", "neg", "label_negative"),
}


def resolve_label_map(id2label: dict | None) -> dict[int, str]:
    """Ids to labels from a model's own names. Unless they name three distinct labels, the default order holds."""
    known = {alias: label for label, aliases in ALIASES.items() for alias in aliases}
    found = {int(i): known[str(name).strip().lower()] for i, name in (id2label or {}).items() if str(name).strip().lower() in known}
    return found if sorted(found.values()) == sorted(LABELS) else dict(enumerate(LABELS))


def polarity_counts(text: Column, lexicon: Lexicon = INDONESIAN) -> Column:
    """struct(pos, neg, blank): polarity words, flipped where one of the two tokens before is a negation (itself not counted).

    Each token becomes one letter, and the two counts are matches in the string of letters. Blank texts have none."""
    kinds = ("n", lexicon.lexicon_negations), ("p", lexicon.positive), ("m", lexicon.negative)

    def letter(t: Column) -> Column:
        found = F.lit(".")
        for k, chosen in reversed(kinds):
            found = F.when(t.isin(*sorted(chosen)), k).otherwise(found) if chosen else found
        return found

    letters = F.array_join(F.transform(F.transform(X.tokens(F.lower(text)), lambda t: F.btrim(t, F.lit(EDGE))), letter), "")
    after = f"(?<=n.{{0,{SCOPE - 1}}})"
    plain = after.replace("<=", "<!")
    count = lambda s, same, other: F.regexp_count(s, F.lit(f"{plain}{same}|{after}{other}"))
    return X.let(letters, lambda s: F.struct(count(s, "p", "m").alias("pos"), count(s, "m", "p").alias("neg"), (s == "").alias("blank")))


def lexicon_prediction(counts: Column) -> list[Column]:
    """sentiment, confidence, scores, method from polarity counts; blank text is neutral, 0 and `empty`."""
    pos, neg, blank = counts["pos"], counts["neg"], counts["blank"]
    total = pos + neg
    sure = lambda n: F.least(F.lit(0.6) + n * F.lit(0.1), F.lit(0.95))
    sentiment = F.when(blank, "neutral").when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
    confidence = F.when(blank, 0.0).when(pos > neg, sure(pos)).when(neg > pos, sure(neg)).otherwise(F.lit(0.5))
    share = lambda n: F.when(blank | (total == 0), 0.0).otherwise(F.round(n / total, 4))
    neutral = F.when(blank, 0.0).when(total == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.lit(1.0) - share(pos) - share(neg)), 4))
    return [
        sentiment.alias("sentiment"), F.round(confidence, 4).alias("confidence"),
        F.struct(share(pos).alias("positive"), neutral.alias("neutral"), share(neg).alias("negative")).alias("scores"),
        F.when(blank, "empty").otherwise("rule-based").alias("method"),
    ]


def score_lexicon(df: DataFrame, text: str = "processed_text", lexicon: Lexicon = INDONESIAN) -> DataFrame:
    """df with sentiment, confidence, scores, method. Text is counted once a row: inline() keeps later filters, which would
    count it anew, above."""
    counted = df.select("*", F.inline(F.array(F.struct(polarity_counts(F.coalesce(F.col(text), F.lit("")), lexicon).alias("_counts")))))
    return counted.select(*df.columns, *lexicon_prediction(F.col("_counts")))


def score_logits(df: DataFrame, logits: str = "logits", labels: dict[int, str] | None = None, config: SentimentConfig = SentimentConfig(), n_tokens: str | None = None) -> DataFrame:
    """Predictions from a model's logits: softmax at the calibration temperature, first maximum, scores in label order."""
    names = labels or resolve_label_map(None)
    prob = X.softmax(F.col(logits), config.temperature)
    table = F.create_map(*[F.lit(x) for i, label in sorted(names.items()) for x in (i, label)])
    of = {label: i for i, label in names.items()}
    out = df.withColumn("_p", prob).withColumn("_top", F.array_position("_p", F.array_max("_p")) - 1)
    scores = F.struct(*(F.round(F.coalesce(F.get("_p", of[k]), F.lit(0.0)) if k in of else F.lit(0.0), 4).alias(k) for k in LABELS))
    cut = (F.col(n_tokens) >= config.max_tokens) if n_tokens else F.lit(False)
    return out.select(
        *df.columns, F.element_at(table, F.col("_top").cast("int")).alias("sentiment"), F.round(F.array_max("_p"), 4).alias("confidence"),
        scores.alias("scores"), F.lit("model").alias("method"), F.lit(config.temperature).alias("temperature"), cut.alias("truncated"),
    )


def padded_length(n_tokens: Column, multiple: int = 8, most: int = 512) -> Column:
    """Length to which a batch is padded: its longest text, up to a multiple."""
    return F.least(F.lit(most), (F.ceil(n_tokens / multiple) * multiple).cast("int"))


def score_with(df: DataFrame, scorer: Callable[[list[str]], list[list[float]]], text: str, partitions: int | None = None, batch: int = 256) -> DataFrame:
    """Adds `logits` and `error` from a plug-in scorer, which runs in Python workers.

    Texts of like length meet in a batch. A batch that fails is halved until the text that breaks the scorer is alone; it
    gets no logits and the message as its error. Blank texts never reach the scorer.
    """
    schema = df.drop("logits", "error")
    spread = schema.withColumn("_len", F.char_length(text))
    spread = (spread.repartitionByRange(partitions, "_len") if partitions else spread).sortWithinPartitions("_len").drop("_len")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def score(texts: list[str]) -> list[tuple]:
            try:
                return [(list(map(float, row)), None) for row in scorer(texts)]
            except Exception as e:
                if len(texts) == 1:
                    return [(None, str(e)[:200])]
                half = len(texts) // 2
                return score(texts[:half]) + score(texts[half:])

        for frame in frames:
            rows: list[tuple] = [(None, None)] * len(frame)
            at = [k for k, t in enumerate(frame[text]) if isinstance(t, str) and t.strip()]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for i, row in zip(part, score([frame[text].iloc[i] for i in part]), strict=True):
                    rows[i] = row
            yield frame.assign(logits=[r[0] for r in rows], error=[r[1] for r in rows])

    from pyspark.sql import types as T

    out = T.StructType([*schema.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    return spread.mapInPandas(run, out)


def finish_model_rows(df: DataFrame, text: str, **options) -> DataFrame:
    """Predictions for scored rows; blank ones are `empty`, failed ones `error`: neutral with confidence 0."""
    scored = score_logits(df, **options)
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    bad = F.col("error").isNotNull()
    none = F.struct(F.lit(0.0).alias("positive"), F.lit(0.0).alias("neutral"), F.lit(0.0).alias("negative"))
    return (
        scored.withColumn("method", F.when(blank, "empty").when(bad, "error").otherwise(F.col("method")))
        .withColumn("sentiment", F.when(blank | bad, "neutral").otherwise(F.col("sentiment")))
        .withColumn("confidence", F.when(blank | bad, 0.0).otherwise(F.col("confidence")))
        .withColumn("scores", F.when(blank | bad, none).otherwise(F.col("scores")))
    )


def distribution(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Percent of each label over rows that are not `empty`; `error` rows count, as neutral."""
    kept = predictions.filter("method != 'empty'")
    share = lambda k: F.round(F.try_divide(F.count_if(F.col("sentiment") == k) * 100, F.count("*")), 2)
    return kept.groupBy(*by).agg(*(F.coalesce(share(k), F.lit(0.0)).alias(k) for k in LABELS), F.count("*").alias("total"))


def metrics(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    real = F.col("method") != "empty"
    sure = F.when(real, F.col("confidence"))
    truncated = F.count_if(F.col("truncated")) if "truncated" in predictions.columns else F.lit(0).cast("long")
    return predictions.groupBy(*by).agg(
        F.coalesce(F.round(F.avg(sure), 4), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.round(F.min(sure), 4), F.lit(0.0)).alias("min_confidence"),
        F.coalesce(F.round(F.max(sure), 4), F.lit(0.0)).alias("max_confidence"), F.count_if(real).alias("total_analyzed"), F.count("*").alias("total_texts"),
        F.count_if(~real).alias("empty"), truncated.alias("truncated"), F.count_if(F.col("method") == "error").alias("failed"),
    )


def review_queue(predictions: DataFrame, config: SentimentConfig = SentimentConfig(), key: str = "doc_idx") -> DataFrame:
    """The least sure predictions below the threshold, in order: rank from 1, at most review_limit rows (a top-k)."""
    flagged = predictions.filter((F.col("method") != "empty") & (F.col("confidence") < config.review_threshold))
    top = flagged.orderBy("confidence", key).limit(config.review_limit)
    return top.withColumn("review_rank", F.row_number().over(Window.orderBy("confidence", key)))


def review_share(predictions: DataFrame, config: SentimentConfig = SentimentConfig()) -> DataFrame:
    real = predictions.filter("method != 'empty'")
    low = F.count_if(F.col("confidence") < config.review_threshold)
    return real.agg(F.lit(config.review_threshold).alias("threshold"), low.alias("count"), F.when(F.count("*") > 0, F.round(low / F.count("*"), 4)).otherwise(0.0).alias("share"))


def summary(dist: DataFrame) -> DataFrame:
    """One sentence a row of a distribution; of equal shares the first in label order leads."""
    most = F.greatest(*LABELS)
    names = {"positive": "positif", "neutral": "netral", "negative": "negatif"}
    name = F.coalesce(*(F.when(F.col(k) == most, names[k]) for k in LABELS))
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("Dari "), s(F.col("total")), F.lit(" teks yang dianalisis, "), s(most), F.lit("% menunjukkan sentimen "), name, F.lit(". Distribusi lengkap: "),
        s(F.col("positive")), F.lit("% positif, "), s(F.col("neutral")), F.lit("% netral, "), s(F.col("negative")), F.lit("% negatif."),
    )
    return dist.withColumn("summary", text)


def analyze(df: DataFrame, config: CleanConfig | None = None, lexicon: Lexicon = INDONESIAN, text: str = "text", key: str = "doc_idx") -> dict[str, DataFrame]:
    """Cleans only if a config is given (with the transformer profile over it), scores, and reports."""
    own = None if config is None else CleanConfig.for_task("transformer", {k: getattr(config, k) for k in CleanConfig.__dataclass_fields__})
    prepared = clean(df, own, text, (key,), lexicon) if own else df.withColumn("processed_text", F.col(text))
    predictions = score_lexicon(prepared, "processed_text", lexicon)
    dist = distribution(predictions)
    return {"predictions": predictions, "distribution": dist, "metrics": metrics(predictions), "review_queue": review_queue(predictions, key=key), "summary": summary(dist)}


def ablation_configs() -> dict[str, CleanConfig | None]:
    """The four preparations that are compared: none; letter case and punctuation; all normalising; what users send. The
    transformer profile comes over the last two, so they must give the same."""
    plain = {"remove_stopwords": False, "stemming": False}
    return {"none": None, "case_and_punctuation": CleanConfig(**plain, fix_typos=False, normalize_slang=False), "normalised": CleanConfig(**plain), "as_sent": CleanConfig()}


def preprocessing_ablation(df: DataFrame, configs: dict[str, CleanConfig | None] | None = None, lexicon: Lexicon = INDONESIAN, text: str = "text", key: str = "doc_idx") -> DataFrame:
    """Predictions of every preparation in one frame, with a column `config`."""
    out = None
    for name, config in (configs or ablation_configs()).items():
        part = analyze(df, config, lexicon, text, key)["predictions"].withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def save_calibration(path: str, temperature: float) -> None:
    Path(path).write_text(json.dumps({"temperature": temperature}))


def load_calibration(path: str, default: float = 1.0) -> float:
    """A driver-side setting. Missing, unreadable or out-of-range files give the default."""
    try:
        value = float(json.loads(Path(path).read_text())["temperature"])
    except (OSError, ValueError, KeyError, TypeError):
        return default
    return value if 0.05 < value < 20 else default
