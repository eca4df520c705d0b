"""Base spans against the contract's patterns; bootstrapping against a plain version."""
import hashlib
import math
import random
import re
import time
from collections import defaultdict

from markscope.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rnd = random.Random(7)
    parts = ["a", "b.c", "@", "@x", ".com", "1.2.3.4", "300.1.1.1", "0001.02.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "+1", "(555)", "123-4567", "12", "9", ".",
             "-", "é", "٣", "+", "%", "_", "1234567890123456", "\n", "555 0100", "..", "@@"]
    for _ in range(6000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert P.base_spans(t) == brute(t), repr(t)
    for t in ["1" * 200_000, "1." * 100_000, "a" * 200_000, "a@" * 100_000, "+1 (" * 50_000, "1 " * 100_000, "x@y." * 50_000]:
        P.mentions(t, P.base_spans(t)[:50])


def test_linear_in_long_runs():
    for t in ["a" * 1_000_000 + " 1", "a" * 1_000_000 + "1@", "a1" * 100_000, "1" * 1_000_000 + " (at) ", "(" * 300_000 + "5", "@" * 300_000 + "1", "x (at)y" * 50_000, "9 " * 100_000]:
        at = time.time()
        P.mentions(t, P.base_spans(t)[:50])
        assert time.time() - at < 4, t[:20]


def test_candidates():
    def kinds(t):
        return [(t[m["s"]:m["e"]], m["kind"]) for m in P.mentions(t, P.base_spans(t)) if not m["seed"]]
    assert kinds("call 030 1234 567 or 123456789012 now") == [("030 1234 567", 3), ("123456789012", 2), ("123456789012", 3)]
    assert kinds("at 300.10.20.30 or user(at)example.org or 12") == [("300.10.20.30", 1), ("300.10.20.30", 3), ("user(at)example.org", 0), ("12", P.OTHER)]
    assert kinds("123abc@host 7") == [("123abc@host", 0), ("7", P.OTHER)]
    long, other = "w" * 300, "v" * 300
    assert P._patterns(f"call {long} 5", 306, 307) == P._patterns(f"call {other} 5", 306, 307) != P._patterns(f"call www {long} 5", 310, 311)[:2]
    assert P._patterns("x" * 40 + " is 5", 44, 45) != P._patterns("y" * 40 + " is 5", 44, 45)


def plain(texts):
    """The bootstrapping rounds with dictionaries."""
    found = [(i, m) for i, t in enumerate(texts) for m in P.mentions(t or "", P.base_spans(t or ""))]
    edges = {((m["v"], m["kind"]), p) for _, m in found for p in m["p"]}
    seeds = {(m["v"], m["kind"]) for _, m in found if m["seed"]}
    against = defaultdict(int)
    for v, p in edges:
        if v in seeds or v[1] == P.OTHER:
            for k in range(P.OTHER):
                against[p, k] += k != v[1]
    trusted, new = dict.fromkeys(seeds, 1.0), {}
    while True:
        f = defaultdict(float)
        for v, p in edges:
            f[p, v[1]] += trusted.get(v, 0)
        conf = {k: x / (x + against[k]) for k, x in f.items() if x >= P.MIN_SUPPORT and x / (x + against[k]) >= P.PATTERN_AT_LEAST}
        miss = defaultdict(float)
        for v, p in edges:
            if (p, v[1]) in conf:
                miss[v] += math.log(1 - min(conf[p, v[1]], 0.999))
        n = len(new)
        new = {v: 1 - math.exp(x) for v, x in miss.items() if 1 - math.exp(x) >= P.TRUST_AT_LEAST and v not in seeds}
        if len(new) == n:
            break
        trusted = {**dict.fromkeys(seeds, 1.0), **new}
    out = []
    for i, t in enumerate(texts):
        base = P.base_spans(t or "")
        best = {}
        for j, m in found:
            if j == i and not m["seed"] and (m["v"], m["kind"]) in new and m["kind"] < P.OTHER:
                best.setdefault((m["s"], m["e"]), []).append((new[m["v"], m["kind"]], -m["kind"]))
        more = [(a, -max(x)[1], b) for (a, b), x in best.items()]
        out.append((base, more))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = P.personal_data(df).collect()
    want = []
    for (i, t, _), (base, more) in zip(rows, plain([r[1] for r in rows])):
        spell = P._spell(base)
        want.append((i, *(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(spell.encode()).hexdigest(), P._spell(sorted(base + more)), len(more)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return df, got


def test_bootstrapping(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("lorem ipsum dolor sit amet".split())
    texts = [f"{word()} please call me at +1 555 010 {1000 + k} {word()} tomorrow" for k in range(12)]
    texts += [f"{word()} please call me at 555-0{100 + k} {word()} tomorrow" for k in range(4)]
    texts += [f"reach us via mail to user{k}@example.com today" for k in range(9)] + ["reach us via mail to someone(at)example today"]
    texts += [f"version {k}.0 of the {word()} 20{k} 1234567" for k in range(8)] + [None, "", "+1 555 010 1000", "nothing here", "z 1" * 30_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (0, texts[0], "x")]
    df, got = check(spark, rows)
    assert sum(r["n_added"] for r in got) >= 5  # the numbers without a country code, the spelled-out address
    assert all(r["n_added"] == 0 for r in got if r["id"] is not None and 26 <= r["id"] < 34)
    assert P.personal_data(df.limit(0)).count() == 0


def test_unseen_values_outnumber_the_seeds(spark):
    texts = [f"please phone: +1 555 010 {1000 + k} any time" for k in range(10)]
    texts += [f"please phone: 555-{1000 + k} any time" for k in range(40)]
    # seeds of another kind and plain numbers speak against a context
    texts += [f"order number +1 555 020 {1000 + k} is open" for k in range(4)] + [f"order number {k} is open" for k in range(30)]
    texts += [f"order number 777-{1000 + k} is open" for k in range(5)]
    _, got = check(spark, [(i, t, "") for i, t in enumerate(texts)])
    added = {r["id"]: r["n_added"] for r in got}
    assert [added[i] for i in range(10, 50)] == [1] * 40
    assert sum(added.values()) == 40


def test_rounds_go_on_until_nothing_is_new(spark):
    """Each context is known from the numbers of the one before it."""
    texts = [f"begin ca +1 555 010 {1000 + k} end" for k in range(6)]
    for hop in range(6):
        texts += [f"other c{chr(97 + hop)} 4930{hop}00{k:04d} {'end' if hop == 0 else 'thing'}" for k in range(6)]
        texts += [f"some c{chr(98 + hop)} 4930{hop}00{k:04d} thing" for k in range(6)]
    _, got = check(spark, [(i, t, "") for i, t in enumerate(texts)])
    added = {r["id"]: r["spans"] for r in got if r["n_added"]}
    assert set(added) == set(range(6, len(texts))) and all(x.startswith("phone:") for x in added.values())
