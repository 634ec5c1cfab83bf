"""The pipeline's stages on a small table: what goes, what stays, and the columns."""

import hashlib
import os
import random

import corpus_pipeline
import pytest

from kinforge.llm import near_copies

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = corpus_pipeline.near_dedup(spark, docs, SF)
    assert rows.columns == columns
    out = corpus_pipeline.run(spark, SF).collect()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) and 100 < len(ids) < docs.count() and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(out[0].asDict())
    assert all(len(r["ids"]) == r["n_tokens"] and hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"] for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "pii", "encoding"]


def jaccard_components(texts):
    """Brute force: for each text the first one of its component of 5-word Jaccard >= 0.8."""
    fold = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in fold]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


def near_texts(seed=7):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for n in [3, 5, 6, 9, 20, 40, 60, 150, 150, 300]:
        base = [r.choice(vocab) for _ in range(n)]
        for edits in [0, 0, 1, 1, 2, 3, 4, 6, 8, 10]:
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(n)] = r.choice(vocab)
            out.append(" ".join(copy))
    return [*out, None, "", " \n", "W1 w2", "w1  w2"]


def test_near_dedup_finds_all_copies(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = jaccard_components(texts)
    assert 20 < len(set(want)) < 80
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted(set(want))


def groups_of(found, docs):
    """Sorted groups of doc_ids, of (node, root) and docs."""
    root = {r["node"]: r["root"] for r in found.collect()}
    out = {}
    for r in docs.select("doc_id", near_copies.node_of().alias("node")).collect():
        out.setdefault(root.get(r["node"], r["node"]), set()).add(r["doc_id"])
    return sorted(map(sorted, out.values()))


def wanted_groups(texts):
    out = {}
    for i, r in enumerate(jaccard_components(texts)):
        out.setdefault(r, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_linked_components(spark):
    texts = near_texts(9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert groups_of(near_copies.linked(docs), docs) == wanted_groups(texts)


def test_large_groups(spark):
    """Long posting lists: copies around a few bases, many pairs just below and above the limit."""
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(3):
        base = [r.choice(vocab) for _ in range(100)]
        for _ in range(70):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(100)] = r.choice(vocab)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = wanted_groups(texts)
    assert 3 < len(want) < 60
    assert groups_of(near_copies.linked(docs), docs) == want


def test_rows_not_ids_decide(spark, tmp_path):
    """Null and repeated doc_ids: each row stands for its own text."""
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    kept = sorted(map(tuple, sorted(corpus_pipeline.near_dedup(spark, docs, SF).collect(), key=key)), key=str)
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, None)], key=str)
    spark.createDataFrame([(1, texts[0]), (2, texts[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, clean), key=str) == sorted([rows[i] for i in (1, 2, 4, 5, 6)], key=str)


def test_stages_brute_force(spark, tmp_path):
    """All five stages on a small table with nulls, repeats, empty texts and clashing columns, against each stage's definition."""
    r = random.Random(5)
    vocab = [f"word{i}" for i in range(300)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    leak, base = line(30), line(120)
    near = base.split()
    near[7], near[90] = "other", "another"
    texts = [line(40), base, " ".join(near), base, leak, line(50) + " mail ann@site.example now", None, "", "12 34 !!", line(20), line(20) + " " + leak]
    rows = [(i if i != 9 else None, t, ["en", "de", None][i % 3], "s", None if t is None else len(t), "k", "p", 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", len(texts[0]), "k", "p", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, pii_kinds string, n_tokens long, lang_pred string")
    spark.createDataFrame([("i", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    sf = str(tmp_path)
    ids = lambda df: sorted((x["doc_id"] for x in df.collect()), key=str)
    assert ids(stage["language"](spark, docs, sf)) == sorted([0, 0, 1, 2, 3, 4, 5, None, 10], key=str)
    assert all(x["lang"] for x in stage["language"](spark, docs, sf).collect())
    kept = wanted_groups([t for t in texts])
    assert ids(stage["near_dedup"](spark, docs, sf)) == sorted([0, 1, 4, 5, 6, 8, None, 10], key=str) and len(kept) == 8
    assert ids(stage["decontamination"](spark, docs, sf)) == sorted([0, 0, 1, 2, 3, 5, 6, 7, 8, None], key=str)
    masked = {x["doc_id"]: x for x in stage["pii"](spark, docs, sf).collect()}
    assert "ann@" not in masked[5]["text"] and masked[5]["text"].endswith("@site.example now") and masked[1]["text"] == base and masked[6]["text"] is None
    out = stage["encoding"](spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns and "n_tokens_" in out.columns and len(out.collect()) == len(rows)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((x["doc_id"] for x in whole), key=str) == sorted([0, 1, 5, None], key=str)
    none = docs.filter("false")
    assert all(s(spark, none, sf).collect() == [] for s in stage.values())
