"""Evaluation and calibration: splits, class statistics, metrics, review yield, span scores, temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.tables import materialize, remove

IGNORED = -100


def stratified_split(df: DataFrame, label: str, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split` (train, val): round(n * ratio) of each class, half to even, at least one and never all; one of a kind
    stays in train. Membership follows a hash of seed and key, so it doesn't depend on partitions. Sizes come from counts
    and the place in hash order from counts of hash buckets, so no class meets in one task."""
    from lontar.functions.ranks import rank_in_group

    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    sizes = n.select(label, F.when(F.col("_n") <= 1, 0).otherwise(F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(ratio))).cast("long")), F.col("_n") - 1)).alias("_val"))
    ranked = rank_in_group(df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))), [label], F.col("_h"), [F.col("_h"), F.col(key)], "_r")
    joined = ranked.withColumnRenamed(label, "_label").join(F.broadcast(sizes), F.col("_label").eqNullSafe(F.col(label)))  # one row a class
    return joined.withColumn("split", F.when(F.col("_r") < F.col("_val"), "val").otherwise("train")).select(*df.columns, "split")


def label_distribution(df: DataFrame, label: str, order: str) -> DataFrame:
    """label, n, pct, majority (of equal counts the first seen), imbalance_ratio (largest to smallest class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    everything = Window.partitionBy()
    return counts.select(
        "label", "n", F.round(F.col("n") * 100 / F.sum("n").over(everything), 2).alias("pct"),
        (F.max(F.struct("n", -F.col("_first"))).over(everything) == F.struct("n", -F.col("_first"))).alias("majority"),
        F.round(F.max("n").over(everything) / F.min("n").over(everything), 2).alias("imbalance_ratio"),
    )


def class_weights(df: DataFrame, label: str, classes: list) -> DataFrame:
    """label, weight: total / (present classes * count), 1.0 for absent classes."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    dimension = df.sparkSession.createDataFrame([(c,) for c in classes], f"label {dict(df.dtypes)[label]}")
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    return dimension.join(counts, "label", "left").crossJoin(F.broadcast(totals)).select("label", F.when(F.col("n") > 0, F.col("total") / (F.col("present") * F.col("n"))).otherwise(1.0).alias("weight"))


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, true: str, pred: str, classes: list) -> DataFrame:
    wide = df.groupBy(F.col(true).alias("true")).pivot(pred, classes).count()
    return wide.select("true", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}") for c in classes))


def class_metrics(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class seen as true or predicted, from confusion cells."""
    flat = cells.select(F.explode(F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
    )).alias("x"))
    sums = flat.groupBy("x.label").agg(F.sum("x.support").alias("support"), F.sum("x.predicted").alias("predicted"), F.sum("x.hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    return sums.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"), "support", ratio(2 * p * r, p + r).alias("_f1"), "hit")


def classification_report(cells: DataFrame) -> DataFrame:
    return class_metrics(cells).agg(
        F.round(F.sum("hit") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg("_f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("_f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"), F.sum("support").alias("support")
    )


def token_f1(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Over arrays of token labels: positions that hold an aspect label (1, 2) in both are hits, whichever of the two."""
    flat = df.select(F.explode(F.arrays_zip(F.col(true).alias("t"), F.col(pred).alias("p"))).alias("x")).select("x.t", "x.p").filter(F.col("t") != IGNORED)
    t, p = F.col("t").isin(1, 2), F.col("p").isin(1, 2)
    n = flat.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return prf(n)


def prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return counts.select("tp", "fp", "fn", F.round(ratio(tp, tp + fp), 4).alias("precision"), F.round(ratio(tp, tp + fn), 4).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"))


def span_prf(gold: DataFrame, pred: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Exact spans: each (document, start, end) once on either side."""
    g = gold.select(key, "start", "end").distinct().withColumn("_g", F.lit(1))
    p = pred.select(key, "start", "end").distinct().withColumn("_p", F.lit(1))
    both = g.join(p, [key, "start", "end"], "full_outer")
    hit = lambda a, b: F.count_if(a & b)
    has_g, has_p = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    return prf(both.agg(hit(has_g, has_p).alias("tp"), hit(~has_g, has_p).alias("fp"), hit(has_g, ~has_p).alias("fn")))


def accept_checkpoint(before: Column, after: Column, min_delta: float = 0.0, force: bool = False) -> Column:
    return F.lit(force) | (F.round(after - before, 4) >= -abs(min_delta))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """ece, n. Bins are (low, high], the first closed below."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col(confidence) * bins) - 1))
    by = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return by.agg(F.coalesce(F.round(F.sum(F.abs(F.col("a") - F.col("c")) * F.col("n")) / F.sum("n"), 4), F.lit(0.0)).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def confidence_buckets(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """bucket, n, share, accuracy over [0,.5) [.5,.7) [.7,.9) [.9,.99) [.99,1.01); empty ones are left out."""
    c = F.col(confidence)
    bucket = F.when(c < 0.5, "[0.00, 0.50)").when(c < 0.7, "[0.50, 0.70)").when(c < 0.9, "[0.70, 0.90)").when(c < 0.99, "[0.90, 0.99)").when(c < 1.01, "[0.99, 1.01)")
    by = df.filter((c >= 0) & (c < 1.01)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(correct).cast("double")), 4).alias("accuracy"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # at most five rows


REVIEW_THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.94, 0.95, 0.98, 0.99)


def review_yield(df: DataFrame, confidence: str, correct: str, thresholds=REVIEW_THRESHOLDS) -> DataFrame:
    """For each threshold: rows below it, errors among them, the share of all errors, and that over the share of rows.

    One aggregate over the table for all thresholds; nothing is joined."""
    wrong = ~F.col(correct)
    low = lambda t: F.col(confidence) < t
    row = df.agg(F.count("*").alias("total"), F.count_if(wrong).alias("errors"), F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(low(t)).alias("reviewed"), F.count_if(low(t) & wrong).alias("caught")) for t in thresholds)).alias("x"))
    flat = row.select("total", "errors", F.inline("x"))
    recall = F.when(F.col("errors") > 0, F.col("caught") / F.col("errors")).otherwise(0.0)
    share = F.when(F.col("total") > 0, F.col("reviewed") / F.col("total")).otherwise(0.0)
    return flat.select("threshold", "reviewed", "caught", F.round(share, 4).alias("share"), F.round(recall, 4).alias("recall"), F.when(share > 0, F.round(recall / share, 2)).otherwise(0.0).alias("lift"))


def errors(df: DataFrame, correct: str, confidence: str, text: str, key: str, n: int = 50) -> DataFrame:
    """The surest wrong rows, with the text's first 400 characters."""
    return df.filter(~F.col(correct)).orderBy(F.desc(confidence), key).limit(n).withColumn(text, F.substring(text, 1, 400))


def fit_temperature(df: DataFrame, logits: str, label: str, low: float = 0.5, high: float = 5.0, rounds: int = 3) -> float:
    """Temperature of least negative log-likelihood: a grid of log T, refined around its best. Each round is one aggregate
    of the whole grid. 1.0 for under 50 rows, all right, all wrong, or a best at the ends of [low, high]."""
    import math

    top = F.array_position(logits, F.array_max(logits)) - 1
    n, right = df.agg(F.count("*"), F.count_if(top == F.col(label))).first()
    if n < 50 or right in (0, n):
        return 1.0
    a, b = math.log(low / 2), math.log(high * 2)
    best = 0.0
    for _ in range(rounds):
        grid = [a + (b - a) * k / 20 for k in range(21)]

        def nll(t: float) -> Column:
            z = F.transform(logits, lambda x: x / F.lit(math.exp(t)))
            most = F.array_max(z)
            return F.sum(most + F.ln(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - most))) - F.get(z, F.col(label)))

        values = df.agg(*(nll(t).alias(f"g{k}") for k, t in enumerate(grid))).first()
        best = grid[min(range(21), key=lambda k: values[k])]
        step = (b - a) / 20
        a, b = best - step, best + step
    found = math.exp(best)
    return found if low <= found <= high else 1.0


def pool_fingerprint(df: DataFrame, text: str, most_chars: int = 1 << 28) -> DataFrame:
    """16 hex digits of SHA-256 over the sorted texts, each followed by a zero byte.

    The digest is over all texts in order, so one row holds them: it is for training pools, and a pool of over most_chars
    characters raises. pool_digest takes tables of any size.
    """
    size = df.agg(F.sum(F.char_length(F.coalesce(text, F.lit("")))).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.coalesce(text, F.lit("")))), lambda t: F.concat(t, F.lit("\0"))), "")
    if (size.first().s or 0) > most_chars:
        raise ValueError(f"the pool has over {most_chars} characters; use pool_digest")
    return df.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"), F.count("*").alias("n"))


def pool_digest(df: DataFrame, text: str) -> DataFrame:
    """fingerprint, n of a table of any size, whatever its order: 16 hex digits of SHA-256 over the digests of 4,096 groups of
    texts, each the sum and the exclusive or of its texts' SHA-256 in 64-bit words. Other digits than pool_fingerprint's."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    word = lambda k: F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long")
    rows = df.select(F.substring(digest, 1, 3).alias("g"), *(word(k).alias(f"w{k}") for k in range(4)))
    sums = [f(F.col(f"w{k}").cast("decimal(38, 0)") if f is F.sum else F.col(f"w{k}")).cast("string") for k in range(4) for f in (F.sum, F.bit_xor)]
    parts = rows.groupBy("g").agg(F.concat_ws(",", *sums).alias("d"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d", "n"))), lambda s: F.concat_ws(":", s["g"], s["d"], s["n"].cast("string"))), ";")
    return parts.agg(F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def retrain_preview(df: DataFrame, label: str, key: str, ratio: float = 0.2) -> DataFrame:
    """Split sizes, imbalance and warnings (imbalance of 10 or more, a class under 10, validation under 5)."""
    split = stratified_split(df, label, key, ratio).agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    dist = label_distribution(df, label, key).agg(F.max("imbalance_ratio").alias("imbalance_ratio"), F.min("n").alias("smallest"))
    row = split.crossJoin(F.broadcast(dist))
    warnings = F.filter(F.array(F.when(F.col("imbalance_ratio") >= 10, "imbalanced"), F.when(F.col("smallest") < 10, "small_class"), F.when(F.col("val") < 5, "small_validation")), lambda w: w.isNotNull())
    return row.withColumn("warnings", warnings)


def robustness_verdict(runs: DataFrame) -> DataFrame:
    """runs: n_in, n_out, topics, largest_share, outlier_rate; adds verdict, the first rule that a run breaks, or ok."""
    verdict = F.when(F.col("n_in") != F.col("n_out"), "misaligned").when(F.col("topics") < 2, "too_few_topics").when(F.col("largest_share") > 0.5, "dominated").when(F.col("outlier_rate") > 0.25, "too_many_outliers").otherwise("ok")
    return runs.withColumn("verdict", verdict)


def seed_variance(runs: DataFrame, measures: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    return runs.groupBy(*by).agg(*(F.round(f(m), 4).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("stdev", F.stddev_samp))), F.count("*").alias("runs"))


def model_agreement(predictions: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Share of documents on which each pair of models (columns model, label) agrees."""
    lists = predictions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("model", "label"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a["model"].alias("model1"), b["model"].alias("model2"), (a["label"] == b["label"]).alias("same")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.model1", "p.model2").agg(F.round(F.avg(F.col("p.same").cast("double")), 4).alias("agreement"), F.count("*").alias("n"))


def training_rows(df: DataFrame, text: str, label: str, labels: list) -> tuple[DataFrame, DataFrame]:
    """Rows that can be trained on, and reason (empty_text, unknown_label), label, n of those that can't."""
    reason = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty_text").when(~F.coalesce(F.col(label).isin(*labels), F.lit(False)), "unknown_label")
    judged = df.withColumn("_reason", reason)
    skipped = judged.filter("_reason is not null").groupBy(F.col("_reason").alias("reason"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return judged.filter("_reason is null").drop("_reason"), skipped


def inherited_temperature(fitted: float, before: float, n_val: int, least: int = 50) -> tuple[float, bool]:
    """Temperature after retraining, and whether it is the one before: so if a small validation set gave no fit."""
    kept = fitted == 1.0 and before != 1.0 and n_val < least
    return (before if kept else fitted), kept


def train_classifier(df: DataFrame, text_tokens: str, label: str, key: str, ratio: float = 0.2, min_delta: float = 0.0, features: int = 1 << 16, force: bool = False, temperature: float = 1.0):
    """Class-weighted logistic regression on hashed TF-IDF, with metrics before (majority class) and after on the validation
    rows, whether the gate on weighted F1 accepts it, and the temperature fitted on the validation logits (or inherited).
    Labels are 0, 1, 2, ...; returns (model, report)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    split = materialize(stratified_split(df, label, key, ratio), "retrain_split")
    sizes = {r[0]: r[1] for r in split.groupBy("split").count().collect()}
    if not sizes.get("val"):
        raise ValueError("no validation rows: add corrections first")
    classes = [r[0] for r in split.select(label).distinct().orderBy(label).collect()]
    train, val = split.filter("split = 'train'"), split.filter("split = 'val'")
    weights = class_weights(train, label, classes).withColumnRenamed("label", label)
    weighted = train.join(F.broadcast(weights), label)  # one row a class
    model = Pipeline(stages=[HashingTF(inputCol=text_tokens, outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="features"), LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=30, regParam=0.01)]).fit(weighted)
    majority = train.groupBy(label).count().orderBy(F.desc("count"), label).first()[0]
    before = classification_report(confusion(val.withColumn("_p", F.lit(majority)), label, "_p")).first()
    scored = materialize(model.transform(val).select(label, F.col("prediction").cast(dict(df.dtypes)[label]).alias("_p"), vector_to_array("rawPrediction").alias("logits")), "retrain_scored")
    after = classification_report(confusion(scored, label, "_p")).first()
    found, inherited = inherited_temperature(fit_temperature(scored.withColumn(label, F.col(label).cast("int")), "logits", label), temperature, sizes["val"])
    delta = round(after.weighted_f1 - before.weighted_f1, 4)
    report = {"before": before.asDict(), "after": after.asDict(), "weighted_f1_delta": delta, "accepted": force or delta >= -abs(min_delta), "temperature": found, "temperature_inherited": inherited, **{k: sizes.get(k, 0) for k in ("train", "val")}}
    remove(split, scored)
    return model, report


def tagging_rows(tags: DataFrame, key: str = "doc_idx") -> DataFrame:
    """key, has_aspect of tagged tokens (key, pos, token, label): what a tagger's split is stratified by."""
    return tags.filter(F.col("label") != IGNORED).groupBy(key).agg(F.max((F.col("label") > 0).cast("int")).alias("has_aspect"))


def train_tagger(tags: DataFrame, key: str = "doc_idx", official: DataFrame | None = None, ratio: float = 0.2, weighted: bool = False, min_delta: float = 0.0, force: bool = False, features: int = 1 << 16, sequence: bool = True, epochs: int = 6, warm: float = 0.1):
    """A token tagger (labels 0 O, 1 B, 2 I; IGNORED ones are left out), with token F1 before (all O) and after, and the gate on
    it. tags has a row a token (key, pos, token, label) or, so that tokens needn't meet, a row a document (key, tokens, labels).
    Documents are split by whether they have an aspect, unless an official validation set, of the same form, is given.

    sequence: a conditional random field over a document's tokens, trained with warm-up and decay, of which the best epoch is
    kept (history tells all; weighted: documents weigh the mean of their labels' weights). Otherwise a logistic regression of
    each token by itself. Returns (model, report)."""
    return (_chain_tagger if sequence else _token_tagger)(tags, official, key, ratio, weighted, lambda delta: force or delta >= -abs(min_delta), features, epochs, warm)


def _tagger_report(scored: DataFrame, accept, train: int, val: int, official: bool, history: list) -> dict:
    before, after = token_f1(scored.withColumn("p", F.transform("t", lambda _: F.lit(0))), "t", "p").first(), token_f1(scored, "t", "p").first()
    delta = round(after.f1 - before.f1, 4)
    return {"before": before.asDict(), "after": after.asDict(), "f1_delta": delta, "accepted": accept(delta), "train": train, "val": val, "split": "official" if official else "stratified", "history": history}


def _label_weights(labels: DataFrame, weighted: bool) -> dict[int, float]:
    """Weights of labels 0, 1, 2 from a column of labels."""
    return {r.label: r.weight for r in class_weights(labels.filter(F.col("label") != IGNORED), "label", [0, 1, 2]).collect()} if weighted else dict.fromkeys(range(3), 1.0)


def in_validation(rows: DataFrame, label: str, key: str, ratio: float = 0.2, seed: int = 42) -> Column:
    """stratified_split as an expression on each row: a class's validation rows are the first in the order of their hashes, so
    its last one tells. Rows are not shuffled to meet their split; the driver gets a row a class."""
    of = lambda k: F.xxhash64(F.lit(seed), k)
    last = stratified_split(rows.select(key, label), label, key, ratio, seed).filter("split = 'val'").groupBy(label).agg(F.max(F.struct(of(F.col(key)).alias("h"), F.col(key).alias("k"))).alias("l"))
    chosen = F.lit(False)
    for value, most in ((r[0], r.l) for r in last.collect()):
        h = of(F.col(key))
        chosen = chosen | (F.col(label).eqNullSafe(F.lit(value)) & ((h < most.h) | ((h == most.h) & (F.col(key) <= F.lit(most.k)))))
    return chosen


def _chain_tagger(tags: DataFrame, official: DataFrame | None, key: str, ratio: float, weighted: bool, accept, features: int, epochs: int, warm: float):
    """Sentences are written once, by their batch, with features of words and not of tokens; training and validation rows are
    told apart as they are read."""
    from lontar.operators import crf

    def stored(rows: DataFrame) -> DataFrame:
        texts = rows if "labels" in rows.columns else crf.tagged_texts(rows.filter("label is not null"), key)
        held = crf.sentences(texts, key, features).filter(F.exists("labels", lambda y: y != IGNORED))
        return materialize(held.withColumn("has_aspect", F.exists("labels", lambda y: y > 0).cast("int")).withColumn("batch", crf.batch_of(F.col(key))), "tagger_sentences", "batch")

    rows = stored(tags)
    other = None if official is None else stored(official)
    chosen = in_validation(rows, "has_aspect", key, ratio) if official is None else None
    train, val = (rows.filter(~chosen), rows.filter(chosen)) if official is None else (rows, other)
    n = val.count()
    if not n:
        raise ValueError("no validation rows: add corrections first")
    weights = _label_weights(train.select(F.explode("labels").alias("label")), weighted)
    real = F.filter("labels", lambda y: y != IGNORED)
    weight = lambda y: F.coalesce(*(F.when(y == k, F.lit(w)) for k, w in weights.items()), F.lit(0.0))
    weighed = train.withColumn("weight", F.aggregate(real, F.lit(0.0), lambda s, y: s + weight(y)) / F.size(real) if weighted else F.lit(1.0))
    model, history = crf.fit(weighed, crf.KIND + 1, features, val, epochs, warm=warm)
    scored = crf.decode(val, model, crf.KIND + 1).select(F.col("labels").alias("t"), F.col("predicted").alias("p"))
    report = _tagger_report(scored, accept, train.count(), n, official is not None, history)
    remove(rows, *([] if other is None else [other]))
    return model, report


def _token_rows(tags: DataFrame, key: str) -> DataFrame:
    flat = tags.select(key, F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("labels").alias("label")))).select(key, "pos", "col.*") if "labels" in tags.columns else tags
    return flat.filter("label is not null")


def _token_tagger(tags: DataFrame, official: DataFrame | None, key: str, ratio: float, weighted: bool, accept, features: int, epochs: int, warm: float):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    tokens = _token_rows(tags, key)
    split = None if official is not None else stratified_split(tagging_rows(tokens, key), "has_aspect", key, ratio).select(key, "split")
    part = lambda name: tokens.join(split.filter(F.col("split") == name).select(key), key) if official is None else tokens if name == "train" else _token_rows(official, key)
    train, val = materialize(part("train"), "tagger_train"), materialize(part("val"), "tagger_val")
    if val.filter(F.col("label") != IGNORED).isEmpty():
        raise ValueError("no validation rows: add corrections first")
    weights = train.sparkSession.createDataFrame(list(_label_weights(train.select(F.col("label").cast("int").alias("label")), weighted).items()), "label int, weight double")

    def framed(rows: DataFrame) -> DataFrame:
        low, order = F.lower("token"), Window.partitionBy(key).orderBy("pos")
        around = {"w": low, "p": F.lag(low).over(order), "q": F.lag(low, 2).over(order), "n": F.lead(low).over(order), "e": F.substring(low, -3, 3), "b": F.substring(low, 1, 3)}
        named = F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), c) for k, c in around.items()), F.lit("bias")))
        return rows.withColumn("_around", named).filter(F.col("label") != IGNORED).withColumn("label", F.col("label").cast("int"))

    model = Pipeline(stages=[HashingTF(inputCol="_around", outputCol="features", numFeatures=features, binary=True), LogisticRegression(labelCol="label", weightCol="weight", family="multinomial", maxIter=30, regParam=1e-4)]).fit(framed(train).join(F.broadcast(weights), "label"))  # one row a label
    scored = model.transform(framed(val)).select(F.array("label").alias("t"), F.array(F.col("prediction").cast("int")).alias("p"))
    count = lambda rows: rows.filter(F.col("label") != IGNORED).select(key).distinct().count()
    report = _tagger_report(scored, accept, count(train), count(val), official is not None, [])
    remove(train, val)
    return model, report
