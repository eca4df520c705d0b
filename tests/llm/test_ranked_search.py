"""Ranked search against a plain version, with small blocks, parts and odd tables."""
import math
import random
import re
from collections import Counter

from markscope.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, top=20):
    d = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(1 for _, c in d if c), sum(sum(c.values()) for _, c in d)
    df = Counter(w for _, c in d for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in d:
            if not c:
                continue
            m = 75 + (25 * sum(c.values()) * n) // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 12 * m))
                    for w, q in Counter(terms(text)).items() if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def got(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("body AS text", "doc_id", "1 AS rank", "'x' AS score")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS item")
    return sorted((tuple(r) for r in R.search(d.repartition(3), q, **kw).collect()), key=repr)


def test_small_blocks_and_parts(spark):
    rnd = random.Random(4)
    vocab = ["the", "é", "A1", "zeta"] + [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rnd.choices(vocab, weights=[80, 40, 9, 1] + [2] * 60, k=rnd.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]       # copies: ties go by id
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 25)))) for i in range(30)]
    want = brute(docs, items, 3)
    assert got(spark, docs, items, top=3, block_rows=40, part_words=100) == want and len(want) > 60
    assert got(spark, docs, items, top=3) == want
    assert got(spark, docs, items) == brute(docs, items)


def test_many_items_in_bundles(spark):
    docs = [(i, f"w{i % 7} w{i % 11} common") for i in range(200)]
    items = [(i, f"w{i % 13} common w{i % 7}") for i in range(600)]
    assert got(spark, docs, items, top=4) == brute(docs, items, 4)


def test_odd_tables(spark):
    docs = [(1, None), (2, ""), (None, "cat"), (3, "cat"), (3, "cat"), (4, "Cat, CAT! dog" + " x" * 200_000), (5, "..."), (6, "É é")]
    items = [(1, "cat"), (1, "cat"), (None, "dog cat cat"), (2, None), (3, ""), (4, "nothing here"), (5, "é")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
    assert got(spark, [(1, None)], items) == []
