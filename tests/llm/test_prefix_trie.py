"""The trie against a plain version: long conversations over several ranges, flat bands, odd rows."""
import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from markscope.llm import prefix_trie as P


def brute(rows, contract=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in own.items():
        base = c - int(c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = t if base == c or not contract else own.get(base, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        own_saved = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += own_saved
    return sorted((min(who), len(node), min(members[node[:-1]]) if node else -10 ** 9, len(who), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(who) if len(built[c]) == len(node)).encode()).hexdigest())
                  for node, who in members.items())


def got(spark, rows, contract=True, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "2 AS conv", "3 AS n")
    conv = F.col("conv")
    args = (conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9) if contract else ()
    out = P.trie(df.repartition(4), *args, **kw)
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"] if r["parent_conv_id"] is not None else -10 ** 9, r["n_convs"], r["n_children"], r["n_leaves"],
                   r["saved_tokens"], r["ends_sha256"]) for r in out.collect())


def test_random_conversations(spark):
    rnd = random.Random(9)
    rows = []
    for c in [*range(-12, 60), 10 ** 12 + 3]:
        rows += [(c, k, rnd.choice(["user", "bot"]), rnd.choice(["a", "bé", ""])) for k in range(rnd.randint(1, 12))]
    rnd.shuffle(rows)
    want = brute(rows)
    assert got(spark, rows) == want
    assert got(spark, rows, height=2) == want
    assert got(spark, rows, contract=False, height=3) == brute(rows, False)


def test_one_conversation_of_very_many_turns(spark):
    rows = [(7, k, "user", f"t{k % 3}") for k in range(400)] + [(c, k, "user", f"t{k % 3}") for c in (5, 11, 12, 13) for k in range(c)]
    rows += [(c, 0, "user", "same") for c in range(100, 300)]
    assert got(spark, rows, height=4) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "a", None), (1, 0, None, "x"), (1, 0, "b", "y"), (None, 0, "user", "lost"), (6, 3, "user", "z"), (6, 3, "user", "z"),
            (9, 0, "user", "long " * 100_000), (2, 5, None, ""), (3, 0, "user", "q"), (0, 0, "", "")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []
    assert got(spark, [(13, 0, "u", "only")]) == brute([(13, 0, "u", "only")])    # its first turns come from a missing one: turnless
