import zlib
from collections import Counter, defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from lontar.llm.merkle_manifest import FIELDS, manifest, op13_merkle_manifest
from tests.llm.cases import SCHEMA, awkward, frame, table

NAMES = [f.name for f in SCHEMA]


def h(text):
    return sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf(row):
    return h("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def climb(nodes):
    """(root, siblings of each leaf as (before, after) from below upwards)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            ways[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes, at = [h("".join(r)) for r in runs], [i // 16 for i in at]
    return nodes[0], ways


def brute(rows):
    sources = defaultdict(list)
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
        sources[r["source"]].append((r["doc_id"], leaf(r), leaf(r | {"text": lowered(r["text"])}) if hit else leaf(r)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[s] = climb([x[1] for x in sources[s]])
    root, ways = climb([built[s][0] for s in order])
    out = []
    for s, above in zip(order, ways, strict=True):
        for (doc, own, fold), below in zip(sources[s], built[s][1], strict=True):
            way = below + above
            for before, after in way:
                fold = h(before + fold + after)
            out.append((doc, own, built[s][0], root, h("".join(b + a for b, a in way)), fold, fold == root))
    return Counter(out)


def checked(docs):
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    low = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return Counter(map(tuple, manifest(docs, {"text": F.when(hit, low).otherwise(docs["text"])}).collect()))


def test_awkward(spark):
    rows = awkward()
    rows += [(100 + i, f"Text {i}", "en", f"s{i % 40}", 3, "k", None, None, 1) for i in range(200)]
    assert checked(frame(spark, rows)) == brute([dict(zip(NAMES, r, strict=True)) for r in rows])


def test_tree_over_many_buckets(spark):
    """A source of three buckets of 4096 leaves, the last one short, beside ones of one leaf, of a full bucket and of one more."""
    of = ["hot"] * 8200 + ["one"] + ["full"] * 4096 + ["over"] * 4097 + [None] * 17
    rows = [(i * 7919 % 20_011, f"Document {i}" if i % 3 else None, "en", s, i, None, None, None, 0) for i, s in enumerate(of)]
    assert checked(frame(spark, rows, 7)) == brute([dict(zip(NAMES, r, strict=True)) for r in rows])


def test_empty_and_one(spark):
    assert manifest(frame(spark, [])).collect() == []
    row = (1, "Alone", "en", None, 5, None, None, None, 0)
    (found,) = manifest(frame(spark, [row], 1)).collect()
    own = leaf(dict(zip(NAMES, row, strict=True)))
    assert tuple(found) == (1, own, own, own, h(""), own, True)


def test_a_changed_field_fails(spark):
    docs = frame(spark, [(i, f"text {i}", "en", "s", 5, None, None, None, 0) for i in range(40)])
    found = manifest(docs, {"n_chars": F.when(docs["doc_id"] == 7, 6).otherwise(docs["n_chars"])}).collect()
    assert sorted(r.doc_id for r in found if not r.verified) == [7]


def test_table(spark, tables):
    assert Counter(map(tuple, op13_merkle_manifest(spark, tables).collect())) == brute(table(tables, "documents"))
