"""Files read in byte ranges: the same rows however the ranges fall, none lost or doubled."""

import json
import random

import pytest

from lontar.sources import readers as R
from lontar.sources.splits import json_elements, read_pieces

#: What a scanner could trip over: separators, brackets, quotes and escapes inside strings, also at their ends.
PARTS = [",", "[", "]", "{", "}", '"', "\\", '\\"', "],", '",', "\n", "é", "中", "😀", ":", " ", '{"data":[', "a", "text", " ", "\t"]


@pytest.fixture
def ranges(spark):
    """Sets the size of ranges, and gives the old one back."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def chosen(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(size))

    yield chosen
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def records(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 12)))
    kinds = [text, lambda: {"text": text(), "more": [text(), [1, {"a": [2, text()]}]]}, lambda: {"odd": [text()], "text": text()}, lambda: rng.randrange(100), lambda: None, lambda: [text(), [text()]], lambda: {}]
    return [rng.choice(kinds)() for _ in range(n)]


def texts(items):
    found = (x if isinstance(x, str) else x.get("text") if isinstance(x, dict) else None for x in items)
    return [t for t in found if t and t.strip(" ")]


def elements(spark, path):
    return [json.loads(r.value) for r in json_elements(spark, path).orderBy("_file", "_block", "_n").collect()]


@pytest.mark.parametrize("ascii_only", [True, False])
def test_one_array_in_eight_ranges(spark, tmp_path, ranges, ascii_only):
    items, path = records(400, 1), tmp_path / "a.json"
    path.write_text(json.dumps(items, ensure_ascii=ascii_only), encoding="utf-8")
    size = path.stat().st_size
    for pieces in (1, 8):
        ranges(size // pieces + 1)
        held = read_pieces(spark, str(path), ",")
        assert held.select("_block").distinct().count() == pieces
        assert elements(spark, str(path)) == items
        assert [r.text for r in R.read_corpus(spark, str(path)).orderBy("doc_idx").collect()] == texts(items)


def test_wrapped_arrays(spark, tmp_path, ranges):
    items = records(60, 2)
    wrapped = [
        ({"data": items}, items), ({"rows": items}, items), ({"note": [1, {"data": [2]}], "data": items, "z": {"a": [3, 4]}}, items),
        ({"a,b": items, "data": {"x": [1]}}, items), ({"n": 1, "rows": items}, []), ({"first": ["x"], "second": items}, ["x"]), ({}, []), ({"data": []}, []), ([], []), ([[]], [[]]), (3, []), ("a,[b", []),
    ]
    ranges(700)
    held = [(content, wanted, indent) for content, wanted in wrapped for indent in (None, 2)]
    for i, (content, _, indent) in enumerate(held):
        (tmp_path / f"{i:02}.json").write_text(json.dumps(content, indent=indent), encoding="utf-8")
    found = {}
    for r in json_elements(spark, str(tmp_path)).orderBy("_file", "_block", "_n").collect():
        found.setdefault(int(r._file[-7:-5]), []).append(json.loads(r.value))
    assert [found.get(i, []) for i in range(len(held))] == [wanted for _, wanted, _ in held]


def test_numbers_over_files(spark, tmp_path, ranges):
    parts = [records(80, s) for s in range(3, 9)]
    for i, items in enumerate(parts):
        (tmp_path / f"p{i}.json").write_text(json.dumps(items if i % 2 else {"data": items}, indent=i % 3 or None), encoding="utf-8")
    ranges(997)
    rows = R.read_corpus(spark, str(tmp_path)).orderBy("doc_idx").collect()
    assert [r.text for r in rows] == [t for items in parts for t in texts(items)] and [r.doc_idx for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize("broken", ['["a", "b"', '["a, "b"]', '{"data": ["a"]'])
def test_files_that_dont_close(spark, tmp_path, broken):
    path = tmp_path / "b.json"
    path.write_text(broken)
    with pytest.raises(Exception, match="do not close"):
        json_elements(spark, str(path)).collect()
    assert json_elements(spark, str(path), strict=False).count() == 0


def test_gold_and_tasks(spark, tmp_path, ranges):
    gold = [{"text": f"t,{i}]", "label": ["positive", " Neutral", "odd", None][i % 4]} for i in range(200)]
    tasks = [{"data": {"text": f"harga {i}, [x"}, "predictions": [{"result": [{"value": {"start": 0, "end": 5, "text": "?", "labels": ["A"]}}]}]} for i in range(90)]
    (tmp_path / "g.json").write_text(json.dumps(gold))
    (tmp_path / "t.json").write_text(json.dumps(tasks, indent=1))
    ranges(512)
    rows = R.read_gold(spark, str(tmp_path / "g.json")).orderBy("doc_idx").collect()
    assert [(r.text, r.label) for r in rows] == [(g["text"], g["label"].strip().lower()) for g in gold if g["label"] in ("positive", " Neutral")]
    assert tuple(R.gold_drops(spark, str(tmp_path / "g.json")).first()) == (100, 100)
    assert sorted((r.text, *map(tuple, r.spans)) for r in R.read_tasks(spark, str(tmp_path / "t.json")).collect()) == sorted((t["data"]["text"], (0, 5)) for t in tasks)


def conll(lines):
    """The rows of one file's lines, by a loop."""
    documents, held = [], []
    for line in [*lines, ""]:
        if not line.strip():
            documents, held = (documents + [held] if held else documents), []
        elif len(parts := line.split("\t")) >= 2:
            held.append((parts[0], parts[1].strip().upper()))
    return documents


def test_conll_in_ranges(spark, tmp_path, ranges):
    rng, wanted = random.Random(5), []
    for i in range(4):
        lines = [rng.choice(["", " ", "broken", "tok\tO", f"ac{i}\tb-x", "x\ty\tz"]) for _ in range(300)]
        (tmp_path / f"f{i}.txt").write_text("\n".join(lines))
        wanted += conll(lines)
    for size in (400, 10**6):
        ranges(size)
        rows = R.read_conll(spark, str(tmp_path)).orderBy("doc_idx", "pos").collect()
        assert [(r.doc_idx, r.pos, r.token, r.label) for r in rows] == [(d, p, t, label) for d, words in enumerate(wanted) for p, (t, label) in enumerate(words)]
