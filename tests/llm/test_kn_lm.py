"""The word model against a plain dictionary version."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from markscope.llm import kn_lm as M
from markscope.llm.kneser_ney import discounts
from markscope.llm.textkit import lower_text

END, START = "</s>", "<s>"


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_text(t)) + [END]


class Brute:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = toks(t)
            self.uni.update(w)
            self.bi.update(zip([START] + w, w))
        self.follow = Counter(w for _, w in self.bi)
        self.ctx, self.kinds = Counter(), defaultdict(Counter)
        for (v, _), c in self.bi.items():
            self.ctx[v] += c
            self.kinds[v][min(c, 3)] += 1
        self.d2 = discounts(*(sum(c == x for c in self.bi.values()) for x in (1, 2, 3, 4)))
        self.d1 = discounts(*(sum(c == x for c in self.follow.values()) for x in (1, 2, 3, 4)))
        self.n, self.v = sum(self.uni.values()), len(self.uni)

    def low(self, w):
        t = len(self.bi)
        if not t:
            return 1 / (self.v + 1)
        c = self.follow[w]
        left = sum(self.d1[min(x, 3) - 1] for x in self.follow.values()) / t
        return (c - (self.d1[min(c, 3) - 1] if c else 0)) / t + left / (self.v + 1)

    def p(self, v, w):
        if not self.ctx[v]:
            return self.low(w)
        c = self.bi[v, w]
        left = sum(self.d2[x - 1] * n for x, n in self.kinds[v].items()) / self.ctx[v]
        return (c - (self.d2[min(c, 3) - 1] if c else 0)) / self.ctx[v] + left * self.low(w)

    def row(self, t):
        w = toks(t)
        return (len(w), sum(self.uni[x] > 0 for x in w), sum(math.log10((self.uni[x] + 1) / (self.n + self.v + 1)) for x in w),
                sum(math.log10(self.p(a, b)) for a, b in zip([START] + w, w)))


def text(rnd, n):
    return " ".join(f"w{int(rnd.paretovariate(0.6)) % 400}" if rnd.random() < .9 else "THE" for _ in range(n))


@pytest.fixture(scope="module", autouse=True)
def small_shards():
    keep = M.PAIR_SHARD_TOKENS, M.WORD_SHARD_WORDS, M.FOLD_AT
    M.PAIR_SHARD_TOKENS, M.WORD_SHARD_WORDS = 500, 90
    yield
    M.PAIR_SHARD_TOKENS, M.WORD_SHARD_WORDS, M.FOLD_AT = keep


def test_against_dictionaries(spark):
    rnd = random.Random(6)
    train = [text(rnd, rnd.randint(0, 60)) for _ in range(150)] + [None, "", "the " * 700, "The the", "The the"]
    probe = train[:40] + [text(rnd, 30) + " unseen words here w1" for _ in range(20)] + [None, "", "x" * 100_000, "ünseen"]
    want = Brute(train)
    model = M.train(spark.createDataFrame([(t, 1) for t in train], "text string, n_tokens int").repartition(5))
    assert (model.n_tokens, model.n_types) == (want.n, want.v)
    df = spark.createDataFrame([(i if i else None, t, 0.0) for i, t in enumerate(probe)], "doc_id long, text string, score double").repartition(3)
    got = {r["id"]: r for r in M.score(df, model).collect()}
    for i, t in enumerate(probe):
        r, w = got[i if i else None], want.row(t)
        assert (r["n_tokens"], r["n_known"]) == w[:2]
        assert math.isclose(r["base_score"], w[2], rel_tol=1e-9) and math.isclose(r["score"], w[3], rel_tol=1e-9), t
    vocab = [*want.uni, "never"]
    for v in ("the", START, "nobody", next(iter(want.uni))):
        assert math.isclose(sum(want.p(v, w) for w in vocab), 1, rel_tol=1e-9)


def test_empty_training_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = M.train(none)
    got = M.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()[0]
    assert (got["n_tokens"], got["n_known"], got["base_score"], got["score"]) == (3, 0, 0.0, 0.0)
    assert M.score(none, model).count() == 0


def test_query_beats_the_base(spark):
    got = M.op5_kneser_ney_lm(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and held and len({r["train_tokens"] for r in got}) == 1
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert sum(r["n_tokens"] for r in got if not r["held_out"]) == got[0]["train_tokens"]


def test_planes():
    for a in (np.array([0, 1, 2**63 + 5], dtype=np.uint64), np.zeros(0, dtype=np.int64), np.array([3, -1])):
        assert np.array_equal(M.unplanes(M.planes(a), a.dtype), a)
