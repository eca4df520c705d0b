"""SimHash near-dedup against a brute-force version."""
import random

import numpy as np
import pytest
import xxhash

from markscope.llm import simhash_dedup as S
from markscope.llm.textkit import lower_text


def brute_fp(text):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_text(text))
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    n = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))


def brute_components(fps, r=2):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= r:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: min(j for j in ids if find(j) == find(i)) for i in ids}


TEXTS = ["", None, "One", "one two", "A b C d\te\n f  g", "a b c d e f g", " x ", "ünï çode wörds ünï çode",
         "w " * 1000, "rare " + "w " * 1000, "z" * 5000, "a b c d e f g", "\x85\xa0 nbsp stays"]


def test_fingerprints_and_components(spark):
    rnd = random.Random(4)
    texts = TEXTS + [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(250)]
    base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 4) for _ in range(400)]
    for _ in range(30):  # near copies
        w = list(base)
        w[rnd.randrange(400)] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long").repartition(3)
    got = {r["id"]: r for r in S.near_duplicates(df).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] & (2**64 - 1) for i, r in got.items()} == fps
    assert {i: r["component"] for i, r in got.items()} == brute_components(fps)
    assert len({r["component"] for r in got.values()}) < len(texts)


@pytest.mark.parametrize("large", [6000, 40])
def test_pivot_links_lose_nothing(spark, large):
    """Random centres with noise of a few bits; a dense ball that no pivot parts well."""
    rnd = np.random.default_rng(1)
    fps = []
    for _ in range(300):
        c = int(rnd.integers(0, 2**63))
        for _ in range(3):
            fps.append(c ^ sum(1 << int(b) for b in rnd.integers(0, 64, rnd.integers(0, 5))))
    fps += [1 << i for i in range(64)] + [0] + [3 << i for i in range(62)]
    fps = list(dict.fromkeys(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    from markscope.llm.components import connected_components
    comp = {r["node"]: r["component"] for r in connected_components(S.pivot_links(df, 2, 30, large)).collect()}
    want = brute_components(dict(enumerate(fps)))
    assert {i: comp.get(i, i) for i in want} == want


def test_empty_table_nulls_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, None), (3, "")], "doc_id long, text string")
    got = sorted((str(r["id"]), r["component"]) for r in S.near_duplicates(df).collect())
    assert got == [("3", 3), ("5", 5), ("5", 5), ("None", 3), ("None", 5)]
