"""Held-out accuracy, the fold, and a brute-force score."""
import random

import numpy as np
import pyarrow as pa

from markscope.llm import quality as Q
from markscope.llm import textkit as K

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in Q.op3_quality_ftrl(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [i for i in labels if i in got and got[i]["held_out"]]
    right = np.mean([got[i]["predicted"] == labels[i] for i in held])
    bad = [got[i]["predicted"] for i in held if labels[i] == 0]
    assert right >= 0.95 and np.mean(bad) <= 0.2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    a, b = Q.learn(docs, labels), Q.learn(docs, flipped)
    assert a[1] == b[1] and np.array_equal(a[0], b[0])


def test_scores_are_sparse_dot_products_of_any_cut():
    rnd = random.Random(3)
    texts = ["", "One", "One one One", "!!", "a b, C d!! é\n\tx", " ".join(rnd.choice("ab CD ! é1".split(" ")) for _ in range(500))]
    w = np.random.default_rng(0).normal(size=Q.DIM)
    data, off = K.string_buffers(pa.array(texts))
    whole = Q.scores(data, off, w, 0.25)
    for t, s, (slots, values) in zip(texts, whole, Q.sparse_rows(data, off)):
        d, o = K.string_buffers(pa.array([t]))
        assert np.isclose(Q.scores(d, o, w, 0.25)[0], s)
        assert np.isclose(1 / (1 + np.exp(-np.clip(0.25 + np.dot(w[slots], values), -35, 35))), s, atol=1e-6)


def test_training_is_plain_ftrl():
    """Weights and bias against a loop over single coordinates."""
    rnd = random.Random(12)
    rows = [(np.array(sorted(rnd.sample(range(40), rnd.randint(0, 8))), dtype=np.int64), rnd.randint(0, 1)) for _ in range(50)]
    rows = [(s, np.array([rnd.random() * 3 for _ in s]), y) for s, y in rows]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= Q.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * Q.L1) / ((Q.BETA + n.get(i, 0.0) ** 0.5) / Q.ALPHA + Q.L2)
    for _ in range(2):
        for slots, values, y in rows:
            x = {**dict(zip(slots.tolist(), values.tolist())), "bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / Q.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got, bias = Q.train(rows, 2)
    assert np.isclose(bias, weight("bias")) and all(np.isclose(got[i], weight(i)) for i in range(40)) and np.count_nonzero(got) <= 40


def test_repeated_ids_and_labels_count_once(spark):
    docs = spark.createDataFrame([(k, "good words" if k % 2 else "bad !! thing") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    keep = lambda k: k >= 0
    a = Q.learn(docs, labels, fold=keep)
    b = Q.learn(docs.union(docs).union(docs), labels.union(labels.filter("doc_id = 1")).union(labels.filter("doc_id = 1")), fold=keep)
    assert a[1] == b[1] and np.array_equal(a[0], b[0])


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (None, "", 9.0), (2, "fine words here", 9.0), (2, "fine words here", 9.0), (5, "x" * 300_000, 9.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (1, 0), (None, 1), (5, None), (2, 1)], "doc_id long, quality int")
    got = Q.score(docs, Q.learn(docs, labels, fold=lambda k: k >= 0))
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    assert len(rows) == 5 and rows[0]["score"] == rows[1]["score"] and rows[2]["score"] > rows[0]["score"]
    none = Q.score(docs, Q.learn(docs, labels.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert Q.score(docs.limit(0), Q.learn(docs.limit(0), labels)).count() == 0
