"""Held-out accuracy, the parts against plain versions, obfuscation, odd tables."""
import numpy as np
import pyarrow as pa

from markscope.llm import textkit as K
from markscope.llm import toxicity as X

SF = "/root/testdata/sf0.01"
NONE = X.Lexicon(*(np.zeros(0, t) for t in (np.uint64, float, np.uint64, float)))


def rows(texts, lex=NONE):
    data, off = K.string_buffers(pa.array(texts, pa.string()))
    return [dict(zip(X.FEATURES, r)) for r in X.features(data, off, lex)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in X.op12_toxicity_gbt(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [i for i in labels if got[i]["held_out"]]
    toxic = [got[i]["predicted"] for i in held if labels[i] == 1]
    clean = [got[i]["predicted"] for i in held if labels[i] == 0]
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.005
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = (sorted((r["doc_id"], r["score"]) for r in X.score(docs, X.learn(docs, y)).select("doc_id", "score").collect()) for y in (labels, flipped))
    assert a == b


def test_features():
    a, b, empty, far = rows(["You are an IDIOT, total scum!!", "You went a long way to see it. Nice. trash", "", "you one two three four five six trash"])
    assert a["seed_rate"] == 2 / 6 and np.isclose(a["near_you"], np.log1p(2)) and a["shout_rate"] == 1 / 6 and np.isclose(a["exclaim_rate"], 2 / 30)
    assert np.isclose(a["capital_rate"], 6 / 22) and np.isclose(a["mark_rate"], 3 / 30)
    assert b["near_you"] == 0 and b["seed_rate"] == 1 / 10 and far["near_you"] == 0
    assert all(v == 0 for v in empty.values())
    for text in ("an 1d10t here", "an i.d.i.o.t here", "an i d i o t here", "an idiooot here", "an id!ot here", "an *id-iot*! here"):
        assert np.isclose(rows([text])[0]["hidden_count"], np.log1p(1)), text
    assert rows(["an idiot! here"])[0]["hidden_count"] == 0 and rows(["a b c 12 3.5 here"])[0]["hidden_count"] == 0
    assert rows(["sh*t sooo wh4t"])[0]["masked_rate"] == 1 / 4
    # rows do not touch: any cut gives the same
    texts = ["stup", "id", "i d", "i o t", "you", "moron"]
    assert rows(texts) == [rows([t])[0] for t in texts]


def test_isotonic_is_the_min_max_formula():
    r = np.random.default_rng(2)
    x = r.integers(0, 30, 80).astype(float)
    y = (r.random(80) < x / 30).astype(float)
    knots, values = X.isotonic(x, y)
    for at in np.unique(x):
        want = max(min(y[(x >= lo) & (x <= hi)].mean() for hi in np.unique(x) if hi >= at) for lo in np.unique(x) if lo <= at)
        assert np.isclose(np.interp(at, knots, values), want)


def plain_tree(x, y, margin, depth):
    """The best of all cuts between values, by Newton gain; leaves as in the module."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)

    def split(rows, left):
        leaf = -X.RATE * g[rows].sum() / (h[rows].sum() + X.RIDGE)
        best = (1e-9, None)
        if left:
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j])[:-1]:
                    a = x[rows, j] <= cut
                    part = lambda m: g[rows][m].sum() ** 2 / (h[rows][m].sum() + X.RIDGE)
                    gain = part(a) + part(~a) - part(np.ones(len(rows), bool))
                    if gain > best[0] + 1e-12:
                        best = (gain, (j, cut))
        if best[1] is None:
            return {tuple(rows): leaf}
        j, cut = best[1]
        return split(rows[x[rows, j] <= cut], left - 1) | split(rows[x[rows, j] > cut], left - 1)

    out = np.zeros(len(y))
    for rows_, leaf in split(np.arange(len(y)), depth).items():
        out[list(rows_)] = leaf
    return out


def test_trees_are_those_of_a_plain_search():
    r = np.random.default_rng(5)
    x = r.integers(0, 8, (60, 3)).astype(float)
    y = 0.6 * (x[:, 0] > 3) + 0.4 * r.random(60)     # shares, so that no two cuts tie
    base, trees = X.grow(x, y, 4)
    margin = np.full(60, base)
    for k in range(4):
        margin = margin + plain_tree(x, y, margin, X.DEPTH)
        assert np.allclose(margin, X._margins(x, base, trees[:k + 1]))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (None, "", 9.0), (2, "you idiot", 9.0), (2, "you idiot", 9.0), (5, "x" * 300_000 + " !", 9.0), (6, "fine words", 1.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (1, 0), (None, 1), (5, None), (2, 1), (6, 0)], "doc_id long, toxic int")
    got = X.score(docs, X.learn(docs, labels, fold=lambda k: k >= 0))
    assert got.columns == ["doc_id", "text", "score"]
    rows_ = got.collect()
    assert len(rows_) == 6 and rows_[0]["score"] == rows_[1]["score"] and rows_[2]["score"] == rows_[3]["score"]
    none = X.score(docs, X.learn(docs, labels.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert X.score(docs.limit(0), X.learn(docs.limit(0), labels)).count() == 0
    one = X.score(docs, X.learn(docs, labels.filter("toxic = 1"), fold=lambda k: k >= 0))
    assert all(0 <= r["score"] <= 1 for r in one.collect())
