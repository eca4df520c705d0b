"""Held-out accuracy, sums to one, brute-force back-off, odd inputs."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from markscope.llm import langid as L
from markscope.llm import textkit as K

SF = "/root/testdata/sf0.01"


def grams_of(texts):
    c = Counter()
    for t in texts:
        s = " " * (L.ORDER - 1)
        for w in "".join(ch.lower() if ch.isalpha() else " " for ch in t).split():
            s += w + " "
        c.update(s[i:i + L.ORDER] for i in range(len(s) - L.ORDER + 1))
    return c


def model_of(texts):
    c = grams_of(texts)
    g = sorted(c)
    parts = L.build(np.array([[ord(x) for x in y] for y in g], dtype=np.uint32), np.array([c[x] for x in g]))
    return {(k, kind): (keys, v) for k, kind, keys, v in parts}


def test_probabilities_sum_to_one():
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(40)) + " " for _ in range(5)]
    m = L.Models({"x": model_of(texts)})
    alphabet = sorted(set("".join(grams_of(texts))))
    for ctx in ("abc", "  a", "zzz", "a b", "  z"):
        cols = [np.full(len(alphabet) + 1, ord(x), dtype=np.uint32) for x in ctx] + [np.array([ord(x) for x in alphabet] + [0x3B1], dtype=np.uint32)]
        assert math.isclose(float(np.exp2(m.log2("x", cols)).sum()), 1.0, rel_tol=1e-9)


def test_entropy_is_a_plain_sum():
    texts = ["one two  three, four!", "ONE two"]
    m = L.Models({"x": model_of(texts)})
    probe = ["Two one; zwei", "", "123 !?", "é"]
    data, off = K.string_buffers(pa.array(probe))
    h, n = m.entropies(data, off)
    for t, a, k in zip(probe, h[:, 0], n):
        c = grams_of([t])
        want = -sum(v * float(m.log2("x", [np.array([ord(ch)], dtype=np.uint32) for ch in g])[0]) for g, v in c.items())
        ends_in_word = t and t[-1].isalpha()  # the brute-force text closes its last word
        if not ends_in_word:
            assert k == sum(c.values()) and math.isclose(a, want / max(k, 1), abs_tol=1e-9)


def plain_model(counts):
    """Interpolated modified Kneser-Ney with dictionaries: a function from context and symbol to a probability."""
    levels = {L.ORDER: dict(counts)}
    for k in range(L.ORDER - 1, 0, -1):
        lower = Counter()
        for g in levels[k + 1]:
            lower[g[1:]] += 1
        levels[k] = dict(lower)

    def discount(k, c):
        n = Counter(levels[k].values())
        n1, n2, n3, n4 = (n[x] for x in (1, 2, 3, 4))
        return L.discount_of(np.array([c]), L.discounts(n1, n2, n3, n4))[0]

    def p(ctx, ch):
        k = len(ctx) + 1
        base = p(ctx[1:], ch) if k > 1 else 1 / (len(levels[1]) + 1)
        seen = {g[-1]: c for g, c in levels[k].items() if g[:-1] == ctx}
        if not seen:
            return base
        total = sum(seen.values())
        gamma = sum(discount(k, c) for c in seen.values()) / total
        own = seen.get(ch, 0)
        return (own - discount(k, own)) / total + gamma * base if own else gamma * base
    return p


def test_entropies_are_those_of_plain_dictionaries():
    rnd = random.Random(4)
    langs = {x: [" ".join("".join(rnd.choice(abc) for _ in range(rnd.randint(1, 5))) for _ in range(12)) + "." for _ in range(4)] for x, abc in (("a", "abcd"), ("b", "cdeé"))}
    m = L.Models({x: model_of(t) for x, t in langs.items()})
    plain = {x: plain_model(grams_of(t)) for x, t in langs.items()}
    probe = ["abba dada.", "ceé de ce!", "zzz abc.", "éa "]
    data, off = K.string_buffers(pa.array(probe))
    h, n = m.entropies(data, off)
    best = m.predict(data, off)[0]
    for t, row, k, lang in zip(probe, h, n, best):
        c = grams_of([t])
        want = {x: -sum(v * math.log2(plain[x](g[:-1], g[-1])) for g, v in c.items()) / k for x in plain}
        assert k == sum(c.values())
        assert all(math.isclose(row[j], want[x], rel_tol=1e-9) for j, x in enumerate(m.langs))
        assert lang == min(sorted(want), key=want.get)


def test_rare_languages_have_models_and_limits(spark):
    rnd = random.Random(3)
    words = {"en": "the and of to in that is was".split(), "de": "der die das und ist nicht ein zu".split()}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(20)), x) for i, x in enumerate(["en", "de"] * 60)]
    for seed in range(6):       # one text only, whatever its hash
        one = rows + [(1000 + seed, "kala vesi talo puu kivi maa taivas", "fi")]
        m = L.learn(spark.createDataFrame(one, "doc_id long, text string, lang string"), fold=lambda k: k >= 0)
        data, off = K.string_buffers(pa.array(["kivi talo vesi", "the was that"]))
        assert m.langs == ["de", "en", "fi"] and m.predict(data, off)[0] == ["fi", "en"]
        assert all(math.isfinite(x) for x in m.limit.values())


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in L.op6_langid_kneser_ney(spark, SF).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i in lang if got[i]["held_out"]]
    assert len(got) == len(lang)
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) >= 0.97
    assert np.mean([got[i]["rejected"] for i in held]) <= 0.1
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_tables(spark):
    rnd = random.Random(8)
    words = ["the and of to in that is was".split(), "der die das und ist nicht ein zu".split()]
    rows = [(i, " ".join(rnd.choice(words[i % 2]) for _ in range(12)) + f" {i}", "de" if i % 2 else "en", 0.5) for i in range(60)]
    rows += [(100, None, "en", 0.5), (101, "", "en", 0.5), (102, "123 !", "de", 0.5), (None, "the the", "en", 0.5), (103, "the of and", None, 0.5),
             (103, "the of and", None, 0.5), (104, "the and of " * 50_000, "en", 0.5), (105, "日本語 αβγ", None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r["id"]: r for r in L.predict(df, L.learn(df)).collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == got[102]["lang_pred"] == "und" and got[101]["score"] == 0
    assert got[103]["lang_pred"] == got[104]["lang_pred"] == got[None]["lang_pred"] == "en" and got[1]["lang_pred"] == "de"
    assert got[105]["rejected"] and not got[58]["rejected"]
    empty = df.limit(0)
    assert L.predict(empty, L.learn(empty)).count() == 0
    assert {r["lang_pred"] for r in L.predict(df, L.learn(empty)).collect()} == {"und"}
