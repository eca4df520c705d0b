"""Decontamination against a brute-force version."""
import random
import re

import pytest

from markscope.llm import decontaminate as D
from markscope.llm.textkit import lower_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    out = []
    for i, t in docs:
        w = WORD.findall(lower_text(t))
        hit, names = set(), set()
        for name, it in items:
            x = WORD.findall(lower_text(it))
            n = min(10, len(x))
            if not n:
                continue
            wins = {tuple(x[p:p + n]) for p in range(len(x) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in wins:
                    hit |= set(range(p, p + n))
                    names.add(str(name) if name is not None else "")
        out.append((i, len(w), len(hit), ",".join(sorted(names))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [10**6, 60])
def test_against_brute_force(spark, block_words):
    rnd = random.Random(5)
    vocab = ["a", "B", "c1", "é", "Long-word", "zz"]
    text = lambda lo, hi, v=vocab: " ".join(rnd.choice(v) for _ in range(rnd.randint(lo, hi)))
    items = [(k, text(1, 30)) for k in range(20)] + [(100, "one"), (101, "x y z"), (102, ""), (103, None), (7, "q " * 12),
                                                      (104, "w " * 40), (105, "w " * 40), (None, "null item id here")]
    docs = [(k, text(0, 60)) for k in range(60)] + [(200, None), (201, ""), (202, "w " * 500), (None, "One"), (203, "One"), (203, "One")]
    for k in range(40):
        body = items[rnd.randrange(20)][1].split(" ")
        a = rnd.randrange(len(body))
        docs.append((300 + k, f"{text(0, 5, ['n', 'm'])}, {' '.join(body[a:]).upper()}; {text(0, 5, ['n', 'm'])}"))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(d, b, block_words=block_words).collect()
    assert sorted(((r["id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got), key=str) == brute(docs, items)


def test_blocks_keep_their_bound(spark, monkeypatch):
    """Copies of one text are one item; very many are several, and no block is larger than its bound."""
    monkeypatch.setattr(D, "COPIES", 7)
    items = [(k, "the same ten words stand in all of these benchmark items here") for k in range(60)] + [(100 + k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(9)]
    b = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = list(D.blocks(b, "item_id", "text", 60))
    assert len(got) >= 4 and sorted(i for x in got for ids in x.ids for i in ids) == sorted(str(k) for k, _ in items)
    assert all(len(x.words) + sum(map(len, x.ids)) <= 60 for x in got)
    d = spark.createDataFrame([(1, items[0][1]), (2, items[-1][1])], "doc_id long, text string")
    rows = {r["id"]: list(r["items"]) for r in D.decontaminate(d, b, block_words=60).collect()}
    assert rows == {1: sorted(str(k) for k in range(60)), 2: ["108"]}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    r = D.decontaminate(d, b).collect()
    assert [(x["n_words"], x["n_hit"], x["items"]) for x in r] == [(3, 0, [])]
    assert D.decontaminate(d.limit(0), d.select(d.doc_id.alias("item_id"), "text")).count() == 0
