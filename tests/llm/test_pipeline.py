from collections import Counter, defaultdict

import corpus_pipeline as C
from lontar.llm.common import materialize
from tests.llm.cases import SCHEMA, awkward, frame, table
from tests.llm.test_best_fit_packing import check as check_packing
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_quality_rules import metrics
from tests.llm.test_shingle_links import groups_of, survivors
from tests.llm.test_source_mixing import targets
from pyspark.sql import functions as F


def stages(spark, docs):
    """Frames before and after each stage, all but the last."""
    out = [docs]
    for name, stage in C.STAGES[:-1]:
        out.append(materialize(stage(spark, out[-1], ""), f"test_{name.replace(' ', '_')}"))
        assert [c for c, _ in out[-1].dtypes] == [c for c, _ in docs.dtypes]
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check(spark, docs, quality=None):
    given, good, lines, near, mixed = stages(spark, docs)
    kept = pairs(good)
    assert not any(metrics(t)[-1] for _, t in kept)
    if quality:
        assert {i for i, _ in kept if i in quality} == {i for i, t in pairs(given) if quality.get(i) == 1 and not metrics(t)[-1]}
    rows = [tuple(r) for r in good.select("doc_id", F.xxhash64("text"), "text").collect()]
    assert Counter(pairs(lines)) == brute_lines(spark, rows)
    assert all(r.n_chars == len(r.text) for r in lines.select("n_chars", "text").collect())
    before = pairs(lines)
    stays = {i for i, _ in pairs(near)}
    assert stays == survivors(before) and near.count() == len(groups_of(before))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in near.select("text", "source").collect():
        sizes[r.source] += len((r.text or "").split())
    for r in mixed.select("text", "source").collect():
        taken[r.source] += len((r.text or "").split())
    longest = max((len((t or "").split()) for _, t in pairs(near)), default=0)
    assert all(abs(taken[s] - t) <= 3 * longest + 1 for s, t in targets(sizes).items())
    assert max(Counter(pairs(mixed)).values(), default=0) <= 3
    return mixed


def test_table(spark, tables):
    quality = {r["doc_id"]: r["quality"] for r in table(tables, "labels")}
    mixed = check(spark, spark.read.parquet(f"{tables}/documents.parquet"), quality)
    check_packing(C.run(spark, tables).collect(), pairs(mixed))


def test_awkward_and_empty(spark):
    prose = " ".join(f"Kalimat{i} nomor kata{i * 7}" for i in range(40))
    rows = awkward() + [(i, prose + " akhir", "id", "s", 1, "x", None, "y", 7) for i in (50, 51, None)]
    check(spark, spark.createDataFrame(rows, SCHEMA))
    last = stages(spark, frame(spark, []))[-1]
    assert last.count() == 0 and C.packing(spark, last, "").count() == 0


def test_clashing_and_dotted_names(spark):
    """Columns named like the stages' own, and one with a dot, go through unchanged."""
    prose = " ".join(f"kata{i} nomor{i * 7}" for i in range(40))
    names = ["_hash", "_d", "_h", "_i", "_row", "_doc", "_n", "a.b", "size", "kept", "copies", "_text", "fp", "rank", "salt"]
    rows = [(i, prose + (" akhir" if i == 2 else f" {i} " * 40), "id", "s", 1, *(f"{n}{i}" for n in names)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    out = stages(spark, docs)[-1]
    assert out.count() > 0
    for r in out.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names)
    assert C.packing(spark, out, "").count() >= out.count()
