"""Prefix trie of conversations, its subtree totals rolled up by depth bands.

1. ``positions``: turns are dealt out by range of (conversation, turn, ...) and numbered where they lie, so a conversation of any
   length is spread over tasks.  A turn's prefix is known by a 128-bit sum of turn hashes times powers of their position: such
   sums add up over tasks, and a conversation that goes on in the next range only needs the totals before it (two
   conversations for each range at most, the only rows that reach the driver).
2. ``rebuilt``: a conversation may take its first turns from another one; the sums are shifted, the turns not read again.
3. ``nodes``: distinct prefixes, counted with partial sums.  Each node carries the keys of its ancestors from its
   parent up to the top of its parent's band, ``HEIGHT`` at most.
4. ``rollup``: within a band every node adds its values to these ancestors and itself.  Then the tops of the bands are a
   trie of their own, ``HEIGHT`` times flatter; it is rolled up the same way, and its completed totals go down to the ancestors
   in the band above.  So a node is exploded ``HEIGHT`` times at most on each level, and the levels are the logarithm of the depth.
5. ``end_digests``: members that end in a node are sorted by range and joined in chunks (an Arrow batch's rows of a node); the digest reads the chunks in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscope.llm import textkit as K
from markscope.llm.common import ship, shuffle_partitions, written

U64 = np.uint64
HEIGHT = 8
HEAD = 8            # a conversation takes this many turns of another one at most
#: Odd, so that powers can be taken back.
BASES = [K._mix_int(1300 + i) | 1 for i in range(2)]
MASK = (1 << 64) - 1
NODE = ["depth", "k1", "k2"]


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2 ** 64 for non-negative n."""
    out, square, n = np.ones(len(n), dtype=U64), base, n.astype(np.int64)
    while len(n) and n.max() > 0:
        out = np.where(n & 1, out * U64(square), out)
        square = square * square & MASK
        n = n >> 1
    return out


def _longs(col: pa.Array) -> np.ndarray:
    return np.asarray(col.to_numpy(zero_copy_only=False)).astype(np.int64)


def positions(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, pos, last, bytes, h1, h2, p1, p2)`` of every turn: h is the prefix with it, p the one before it."""
    spark = turns.sparkSession
    ship(spark)
    conv = F.col(conv_col).cast("long")
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = (turns.select(conv.alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("t1"),
                         F.xxhash64(F.lit(2), role, text).alias("t2"), F.octet_length(text).cast("long").alias("bytes"))
            .filter("conv IS NOT NULL").withColumn("copy", F.monotonically_increasing_id()))
    order = ["conv", "turn", "role", "t1", "t2", "copy"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv_now, seen, sums = None, 0, [0, 0]
        for b in batches:
            c = _longs(b.column(0))
            if len(c) == 0:
                continue
            new = np.ones(len(c), dtype=bool)
            new[1:] = c[1:] != c[:-1]
            new[0] = c[0] != conv_now
            begin = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
            pos = np.arange(len(c)) - np.maximum(begin, 0) + np.where(begin < 0, seen, 0)
            out = []
            for k, base in enumerate(BASES):
                term = _longs(b.column(1 + k)).view(U64) * _powers(base, pos)
                total = np.cumsum(term)
                before = np.where(begin > 0, total[np.maximum(begin, 1) - 1], U64(0))
                total = total - before + np.where(begin < 0, U64(sums[k]), U64(0))
                out.append(total)
            conv_now, seen, sums = int(c[-1]), int(pos[-1]) + 1, [int(t[-1]) for t in out]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.full(len(c), part, np.int32)), pa.array(pos.astype(np.int64)), b.column(3), b.column(1), b.column(2),
                pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64))], ["conv", "part", "pos", "bytes", "t1", "t2", "h1", "h2"])

    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    local = written(dealt.select("conv", "t1", "t2", "bytes").mapInArrow(
        number, "conv long, part int, pos long, bytes long, t1 long, t2 long, h1 long, h2 long"), "trie-turns")

    # conversations that lie in several ranges: the first or last one of a range
    edges = sorted(tuple(r) for r in local.groupBy("part").agg(F.min("conv"), F.max("conv")).collect())
    split = sorted({a[2] for a, b in zip(edges, edges[1:]) if a[2] == b[1]})
    start: dict[tuple[int, int], tuple[int, int, int]] = {}
    end: dict[int, int] = {}
    if split:
        few = F.broadcast(spark.createDataFrame([(c,) for c in split], "conv long"))    # one for each range at most
        sums = (local.join(few, "conv", "left_semi").groupBy("conv", "part").agg(F.count("*").alias("n"), F.max_by("h1", "pos").alias("h1"), F.max_by("h2", "pos").alias("h2")))
        at: dict[int, tuple[int, int, int]] = {}
        for r in sorted(sums.collect()):
            n, a, b = at.get(r["conv"], (0, 0, 0))
            start[r["conv"], r["part"]] = n, a, b
            at[r["conv"]] = (n + r["n"], (a + pow(BASES[0], n, 1 << 64) * r["h1"]) & MASK, (b + pow(BASES[1], n, 1 << 64) * r["h2"]) & MASK)
        end = {c: n for c, (n, _, _) in at.items()}
    shared = spark.sparkContext.broadcast((start, end))

    def globalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, end = shared.value
        known = np.array(sorted(end), dtype=np.int64)
        for b in batches:
            c, part, pos = _longs(b.column(0)), _longs(b.column(1)), _longs(b.column(2))
            t, h = [_longs(b.column(k)).view(U64) for k in (4, 5)], [_longs(b.column(k)).view(U64) for k in (6, 7)]
            p = [h[k] - t[k] * _powers(base, pos) for k, base in enumerate(BASES)]
            hit = np.isin(c, known)
            for conv, piece in sorted({(int(x), int(y)) for x, y in zip(c[hit], part[hit])}):
                n, a, z = start[conv, piece]
                rows = np.flatnonzero(hit & (c == conv) & (part == piece))
                pos[rows] += n
                for k, before in enumerate((a, z)):
                    step = U64(pow(BASES[k], n, 1 << 64))
                    h[k][rows] = h[k][rows] * step + U64(before)
                    p[k][rows] = p[k][rows] * step + U64(before)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pos), b.column(3), *(pa.array(x.view(np.int64)) for x in (*h, *p))],
                                             ["conv", "pos", "bytes", "h1", "h2", "p1", "p2"])

    return local.mapInArrow(globalise, "conv long, pos long, bytes long, h1 long, h2 long, p1 long, p2 long")


def rebuilt(at: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns come from conversation ``base`` (both are expressions of ``conv``).

    Returns the turns ``(conv, depth, k1, k2, q1, q2, bytes, is_end)`` (k: the prefix with the turn, q: the one before) and
    ``(conv)`` of those that are left without any turn.
    """
    entry = F.struct("pos", "bytes", "h1", "h2", "p1", "p2")
    # HEAD turns of a conversation at most, and its length
    heads = written(at.groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("pos") < HEAD, entry))).alias("own"),
                                           F.count("*").alias("n")), "trie-heads")
    asked = heads.select("conv", "own", "n", base.alias("base"), head.cast("int").alias("h"))
    other = heads.select(F.col("conv").alias("base"), F.col("own").alias("theirs"))
    info = asked.filter("NOT base <=> conv").join(other, "base", "left").withColumn(
        "m", F.least("h", F.coalesce(F.size("theirs"), F.lit(0))))
    info = info.select("conv", "n", "h", "m", "own", F.expr("slice(theirs, 1, m)").alias("theirs"),
                       F.expr("if(m > 0, theirs[m - 1], null)").alias("b"), F.expr("if(n >= h AND h > 0, own[h - 1], null)").alias("o"))
    info = written(info.selectExpr("conv", "n", "h", "m", "own", "theirs", "coalesce(b.h1, 0L) AS b1", "coalesce(b.h2, 0L) AS b2",
                                   "coalesce(o.h1, 0L) AS o1", "coalesce(o.h2, 0L) AS o2"), "trie-info")
    taken = info.select("conv", "n", "h", "m", F.explode("theirs").alias("e")).selectExpr(
        "conv", "e.pos + 1 AS depth", "e.h1 AS k1", "e.h2 AS k2", "e.p1 AS q1", "e.p2 AS q2", "e.bytes", "n <= h AND e.pos = m - 1 AS is_end")
    turn = "pos, bytes, h1, h2, p1, p2"
    keys = "conv, n, h, m, b1, b2, o1, o2"
    near = info.select(*keys.split(", "), F.explode(F.expr("slice(own, h + 1, 8)")).alias("e")).select(*keys.split(", "), "e.*")
    # turns beyond the heads; a conversation of very many turns is a hot key that adaptive execution splits
    far = at.filter(F.col("pos") >= HEAD)
    beyond = far.join(info.select(*keys.split(", ")), "conv")
    shift = near.select(*(keys + ", " + turn).split(", ")).unionByName(beyond.select(*(keys + ", " + turn).split(", ")))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {name: _longs(b.column(i)) for i, name in enumerate(b.schema.names)}
            out = []
            back = (col["h"] - col["m"])
            for side in ("h", "p"):
                for k, base in enumerate(BASES):
                    step = _powers(pow(base, -1, 1 << 64), back)
                    x = col[f"{side}{k + 1}"].view(U64) - col[f"o{k + 1}"].view(U64)
                    out.append((x * step + col[f"b{k + 1}"].view(U64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(col["conv"]), pa.array(col["pos"] + 1 - back), *(pa.array(x) for x in out), pa.array(col["bytes"]),
                                              pa.array(col["pos"] == col["n"] - 1)], ["conv", "depth", "k1", "k2", "q1", "q2", "bytes", "is_end"])

    shape = "conv long, depth long, k1 long, k2 long, q1 long, q2 long, bytes long, is_end boolean"
    own = shift.mapInArrow(moved, shape)
    same = asked.filter("base <=> conv").select("conv", "n")
    whole_near = asked.filter("base <=> conv").select("conv", "n", F.explode("own").alias("e")).select("conv", "n", "e.*")
    whole_far = far.join(same, "conv").select(*whole_near.columns)
    whole = whole_near.unionByName(whole_far).selectExpr(
        "conv", "pos + 1 AS depth", "h1 AS k1", "h2 AS k2", "p1 AS q1", "p2 AS q2", "bytes", "pos = n - 1 AS is_end")
    turns = taken.unionByName(own).unionByName(whole)
    return turns, info.filter("n <= h AND m = 0").select("conv")


def _key(c1: str, c2: str) -> Column:
    return F.struct(F.col(c1).alias("k1"), F.col(c2).alias("k2"))


def _with_ancestors(rows: DataFrame, height: int) -> DataFrame:
    """Add ``above``: keys from the top of the parent's band down to the parent (``height`` at most)."""
    carry = [c for c in rows.columns if c != "conv"]
    band = rows.groupBy("conv", F.expr(f"(depth - 1) div {height}").alias("band")).agg(F.sort_array(F.collect_list(F.struct(*carry))).alias("e"))
    one = band.select("conv", F.posexplode("e").alias("i", "x"), F.expr("transform(e, y -> struct(y.q1 AS k1, y.q2 AS k2))").alias("q"))
    return one.select("conv", "x.*", F.expr("slice(q, 1, i + 1)").alias("above"))


def _nodes(rows: DataFrame) -> DataFrame:
    """Distinct prefixes with their counts; all members of a node have the same ancestors."""
    return rows.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.count_if("is_end").alias("n_ends"),
                                   F.min("bytes").alias("bytes"), F.min("above").alias("above"))


def _banded(nodes: DataFrame, values: list[str], height: int) -> DataFrame:
    """Sums of ``values`` over the nodes of a band below each of its nodes, itself included."""
    n = F.size("above")
    own = F.array(F.struct(F.col("depth"), F.col("k1"), F.col("k2")))
    up = F.transform("above", lambda a, i: F.struct((F.col("depth") - n + i).alias("depth"), a["k1"].alias("k1"), a["k2"].alias("k2")))
    targets = F.when(F.col("depth") % height == 0, own).otherwise(F.concat(up, own))
    spread = nodes.select(F.explode(targets).alias("a"), *values).select("a.*", *values)
    return spread.groupBy(*NODE).agg(*(F.sum(v).alias(v) for v in values))


def rollup(rows: DataFrame, nodes: DataFrame, root: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """``(depth, k1, k2, *values)``: the sums of ``values`` over each node's subtree.

    ``nodes``: every node but the root, with ``above`` and ``values``; ``root``: the root's row; ``rows``: members' rows with
    ``conv, depth, k1, k2, above``, from which the paths of the flatter levels are read.
    """
    zero = F.array().cast("array<struct<k1:bigint,k2:bigint>>")
    levels = []
    while True:
        full = nodes.select(*NODE, "above", *values).unionByName(root.select(*NODE, zero.alias("above"), *values))
        part = written(_banded(full, values, height), "trie-band")
        levels.append((full, part))
        tops = rows.filter(F.col("depth") % height == 0)
        if tops.isEmpty():
            break
        tops = tops.select("conv", F.expr(f"depth div {height}").alias("depth"), "k1", "k2", F.col("above")[0]["k1"].alias("q1"), F.col("above")[0]["k2"].alias("q2"))
        rows = written(_with_ancestors(tops, height), "trie-tops")
        flat = part.filter(F.col("depth") % height == 0).withColumn("depth", F.expr(f"depth div {height}"))
        root = flat.filter("depth = 0")
        nodes = flat.filter("depth > 0").join(rows.groupBy(*NODE).agg(F.min("above").alias("above")), NODE)
    _, total = levels.pop()
    while levels:
        full, part = levels.pop()
        # completed totals of the tops go to their ancestors in the band above
        done = total.filter("depth > 0").withColumn("depth", F.col("depth") * height)
        down = full.filter(f"depth > 0 AND depth % {height} = 0").select(*NODE, "above").join(done, NODE)
        n = F.size("above")
        up = F.transform("above", lambda a, i: F.struct((F.col("depth") - n + i).alias("depth"), a["k1"].alias("k1"), a["k2"].alias("k2")))
        more = down.select(F.explode(up).alias("a"), *values).select("a.*", *values)
        total = written(part.unionByName(more).groupBy(*NODE).agg(*(F.sum(v).alias(v) for v in values)), "trie-totals")
    return total


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)``: digest of the ascending, comma-joined ids of ``(depth, k1, k2, conv)``."""
    spark = ends.sparkSession
    ship(spark)
    order = [*NODE, "conv"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            key = np.stack([_longs(b.column(i)) for i in range(3)])
            conv = _longs(b.column(3))
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            first = np.concatenate([[0], cut])
            text = conv.astype(str)
            joined = [",".join(text[i:j]) for i, j in zip(first, [*first[1:], len(conv)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[first]) for k in key), pa.array(conv[first]), pa.array(joined, pa.large_string()).cast(pa.string())],
                                             [*NODE, "conv", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for b in batches:
            for *key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], r)) for r in out], schema=shape)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], (*now, h.hexdigest())))], schema=shape)

    shape = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    n = shuffle_partitions(spark)
    chunks = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(join, "depth long, k1 long, k2 long, conv long, ids string")
    # the rows of a node are chunks now: a hash is made in one piece, from few rows
    return chunks.repartition(n, *NODE).sortWithinPartitions(*order).mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, base: Column | None = None, head: Column | None = None, height: int = HEIGHT, conv_col: str = "conv_id",
         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct prefix of the conversations of ``turns``; see ``op13_prefix_trie`` for the columns.

    ``base`` and ``head`` (of column ``conv``) rebuild conversations: the first ``head`` (``HEAD`` at most) turns of ``base``, then
    the own turns after as many; without them conversations are as they are.  Turns are in order of ``turn`` (null first); equal ones by
    role, then by a hash of role and text.  Null roles and texts are empty; turns without a conversation id are left out; repeated rows are
    turns of their own; other columns are not read.  An empty table gives no rows, not even a root.
    """
    at = written(positions(turns, conv_col, turn_col, role_col, text_col), "trie-positions")
    rows, bare = rebuilt(at, base if base is not None else F.col("conv"), head if head is not None else F.lit(0))
    rows = written(_with_ancestors(rows, height), "trie-rows")
    nodes = written(_nodes(rows), "trie-nodes")
    zero = [F.lit(0).cast("long").alias(c) for c in NODE]
    # the root: all conversations are its members
    everyone = at.filter("pos = 0").select("conv", F.lit(0).alias("bare")).unionByName(bare.withColumn("bare", F.lit(1)))
    root = written(everyone.agg(F.min("conv").alias("conv"), F.count_if(F.col("bare") == 0).alias("n"), F.count_if(F.col("bare") == 1).alias("n_ends"))
                   .filter("n > 0").select(*zero, "conv", "n", "n_ends", F.lit(0).cast("long").alias("bytes")), "trie-root")
    leaf = (F.col("n_ends") == F.col("n")).cast("long").alias("n_leaves")
    saved = ((F.col("n") - 1) * F.col("bytes")).alias("saved_tokens")
    total = rollup(rows, nodes.select(*NODE, "above", leaf, saved), root.select(*NODE, leaf, saved), ["n_leaves", "saved_tokens"], height)
    parent = F.element_at("above", -1)
    every = nodes.select(*NODE, "conv", "n", (F.col("depth") - 1).alias("pd"), parent["k1"].alias("pk1"), parent["k2"].alias("pk2")).unionByName(
        root.select(*NODE, "conv", "n", *(F.lit(None).cast("long").alias(c) for c in ("pd", "pk1", "pk2"))))
    children = every.filter("pd IS NOT NULL").groupBy(F.col("pd").alias("depth"), F.col("pk1").alias("k1"), F.col("pk2").alias("k2")).agg(F.count("*").alias("n_children"))
    ends = end_digests(rows.filter("is_end").select(*NODE, "conv").unionByName(bare.select(*zero, "conv")))
    whole = reduce(lambda a, b: a.join(b, NODE, "left"), [children, total, ends], every)
    whole = written(whole, "trie-whole")
    above = whole.select(F.col("depth").alias("pd"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv").alias("parent_conv_id"))
    # a parent of very many children is a hot key: nothing follows this join, so adaptive execution may split it
    out = whole.join(above, ["pd", "pk1", "pk2"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
                      F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Registered query: the trie of conversations whose first turns come from the first of their five."""
    conv = F.col("conv")
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv - conv % 5,
                F.crc32(conv.cast("string").cast("binary")) % 9)


OP13_SQL = """
WITH RECURSIVE ids AS (
    SELECT conv_id AS c, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda r, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(r, x)), 4294967295) AS crc
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id AS c, list(sha256(coalesce(role, '') || chr(1) || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t,
               list(strlen(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS b FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
made AS (SELECT i.c, xor(crc, 4294967295) % 9 AS h FROM ids i),
built AS (SELECT m.c, CASE WHEN m.c % 5 = 0 THEN o.t ELSE coalesce(x.t, [])[1:h] || o.t[h + 1:] END AS t,
                 CASE WHEN m.c % 5 = 0 THEN o.b ELSE coalesce(x.b, [])[1:h] || o.b[h + 1:] END AS b
          FROM made m JOIN own o ON o.c = m.c LEFT JOIN own x ON x.c = m.c - m.c % 5),
member AS (SELECT c, d, sha256(array_to_string(t[1:d], ',')) AS k, sha256(array_to_string(t[1:d - 1], ',')) AS q,
                  CASE WHEN d = 0 THEN 0 ELSE b[d] END AS bytes, d = len(t) AS is_end
           FROM (SELECT c, t, b, unnest(range(len(t) + 1)) AS d FROM built)),
node AS (SELECT d, k, min(c) AS c, min(q) AS q, count(*) AS n, min(bytes) AS bytes, count(*) FILTER (is_end) AS n_ends,
                coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '') AS ends FROM member GROUP BY d, k),
below AS (SELECT m.d, m.k, sum((v.n = v.n_ends)::BIGINT) AS leaves, sum((v.n - 1) * v.bytes) AS saved
          FROM node v JOIN member m ON m.c = v.c AND m.d <= v.d GROUP BY m.d, m.k),
kids AS (SELECT d - 1 AS d, q AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL)
SELECT v.c AS conv_id, v.d AS depth, p.c AS parent_conv_id, v.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM node v JOIN below USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN node p ON p.d = v.d - 1 AND p.k = v.q
"""
