"""Ranked lexical search by pipelined term partitioning.

1. ``index``: one scan turns each slice of documents into a block (ids, lengths) and, for each of ``OWNERS`` term owners, the
   postings of its terms in that block (a term belongs to the owner that its hash names).  Only terms of the items are kept.
2. ``N``, ``L`` and each term's ``df`` are sums over the blocks; with them a posting's contribution is an integer.
3. ``pipeline``: a bundle is a group of items in one block of documents, with a sparse accumulator of scores for each item.  The
   bundles go through the owners one after the other: ``cogroup`` brings an owner's postings of the block, and their
   contributions are added.  After each owner a document leaves an accumulator if even the highest contributions of all terms
   still to come could not lift it to the 20th score that the block has reached: it can't be in the result.
4. After the last owner each bundle gives its highest documents, and a window (limited on the map side) ranks them over all blocks.

The items are a query set: they are read in parts of at most ``ITEM_WORDS`` words, one after the other, and each is held against
all documents.  Blocks are slices of the scan, so no term, item or document is a key that one task must hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markscope.llm import textkit as K
from markscope.llm.common import running_parts, ship, written

U64 = np.uint64
OWNERS = 4
TOP = 20
BLOCK_ROWS = 4096
ITEM_WORDS = 2_000_000
BUNDLE_ITEMS = 256
HIGHEST = 1_000_000     # a term's contribution is below its weight times this


def _words(col: pa.Array, block_rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end, word hashes, first word of each row)`` slice by slice."""
    data, off = K.string_buffers(col)
    for i, j in K.slices(off):
        for a in range(i, j, block_rows):
            b = min(a + block_rows, j)
            d, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
            starts, ends, ptr = K.word_bounds(d, o, K.ALNUM_WORD)
            yield a, b, K.word_hashes(d, starts, ends), ptr


class Items(NamedTuple):
    """A part of the query set: distinct terms (sorted hashes), and for each owner the (item, term, repeats) in it."""

    ids: list
    terms: np.ndarray
    owner: np.ndarray
    item: np.ndarray
    term: np.ndarray
    repeats: np.ndarray


def item_parts(items: DataFrame, id_col: str, text_col: str, part_words: int = ITEM_WORDS) -> Iterator[Items]:
    """The query set in parts of at most ``part_words`` words (or one item), one at a time on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, ptr in _words(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([h[p:q].tobytes() for p, q in zip(ptr, ptr[1:])], pa.binary())], ["id", "h"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, h binary").filter(F.length("h") > 0)
    part = running_parts(written(rows.withColumn("words", F.expr("length(h) div 8")), "search-items"), "words", part_words)
    for n in sorted(r["part"] for r in part.select("part").distinct().collect()):
        got = part.filter(F.col("part") == n).select("id", "h").orderBy("id", "h").collect()
        hashes = [np.frombuffer(r["h"], dtype=U64) for r in got]
        flat = np.concatenate(hashes)
        terms, at = np.unique(flat, return_inverse=True)
        which = np.repeat(np.arange(len(got)), [len(h) for h in hashes])
        pair, repeats = np.unique(which * len(terms) + at, return_counts=True)
        yield Items([r["id"] for r in got], terms, (K.mix(terms) % U64(OWNERS)).astype(np.int64), pair // len(terms), pair % len(terms), repeats)


class Block(NamedTuple):
    """Postings of some terms in a block, sorted by term."""

    terms: np.ndarray
    counts: np.ndarray
    docs: np.ndarray
    tf: np.ndarray


def index(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (owner -1: ``ids, lens``) and postings (one row for each owner with any), as packed arrays."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((items.terms, items.owner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, owner = shared.value
        part, n = TaskContext.get().partitionId(), 0
        empty = b""
        for b in batches:
            ids = np.asarray(b.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)).astype(np.int64)
            for i, j, h, ptr in _words(b.column(1), block_rows):
                block = part << 32 | n
                n += 1
                lens = np.diff(ptr).astype(np.int64)
                rows = [(block, -1, int((lens > 0).sum()), int(lens.sum()), ids[i:j].tobytes(), lens.tobytes(), empty, empty)]
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                known = np.flatnonzero(terms[at] == h)
                doc = np.searchsorted(ptr, known, side="right") - 1
                pair, tf = np.unique(at[known] * (j - i) + doc, return_counts=True)
                t, doc = pair // (j - i), (pair % (j - i)).astype(np.int32)
                for s in range(OWNERS):
                    mine = owner[t] == s
                    if mine.any():
                        u, c = np.unique(t[mine], return_counts=True)
                        rows.append((block, s, 0, 0, u.astype(np.int32).tobytes(), c.astype(np.int32).tobytes(), doc[mine].tobytes(), tf[mine].astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), shape.types)], shape.names)

    shape = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
                       ("a", pa.binary()), ("b", pa.binary()), ("docs", pa.binary()), ("tf", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, "block long, owner int, n_docs long, n_terms long, a binary, b binary, docs binary, tf binary")
    return written(rows, "search-index", "owner")


def _df(table: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the items (a number for each term: bounded by the part of the query set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for b in batches:
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[np.frombuffer(a, np.int32)] += np.frombuffer(c, np.int32)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    df = np.zeros(n_terms, dtype=np.int64)
    parts = table.filter("owner >= 0").select("a", "b").mapInArrow(run, "term long, n long")
    for term, n in parts.groupBy("term").agg(F.sum("n")).collect():
        df[term] = n
    return df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Plan(NamedTuple):
    """What the stages need of a part of the query set; bounded by its words."""

    n: int
    length: int
    weights: np.ndarray
    per_owner: list      # (first, term, item, repeats) by item group: pairs sorted by term
    rest: np.ndarray     # rest[s, item]: the highest that owners after s can add
    items: int


def _plan(items: Items, n: int, length: int, df: np.ndarray) -> Plan:
    weights = np.array([weight(n, int(x)) for x in df], dtype=np.int64)
    worth = items.repeats * weights[items.term]
    n_items = len(items.ids)
    each = np.zeros((OWNERS, n_items), dtype=np.int64)
    np.add.at(each, (items.owner[items.term], items.item), worth)
    rest = (each[::-1].cumsum(axis=0)[::-1] - each) * HIGHEST
    per_owner = []
    for s in range(OWNERS):
        use = np.flatnonzero((items.owner[items.term] == s) & (worth > 0))
        groups = []
        for g in range(0, n_items, BUNDLE_ITEMS):
            mine = use[(items.item[use] >= g) & (items.item[use] < g + BUNDLE_ITEMS)]
            mine = mine[np.argsort(items.term[mine], kind="stable")]
            groups.append((items.term[mine], items.item[mine] - g, items.repeats[mine].astype(np.int64)))
        per_owner.append(groups)
    return Plan(n, length, weights, per_owner, rest, n_items)


def _add(plan: Plan, s: int, group: int, lens: np.ndarray, item: np.ndarray, doc: np.ndarray, score: np.ndarray,
         block: Block | None, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One owner's work on one bundle: the accumulators with its contributions, without what can't be in the result."""
    nd = len(lens)
    n_items = min(BUNDLE_ITEMS, plan.items - group * BUNDLE_ITEMS)
    acc = np.zeros(n_items * nd, dtype=np.int64)
    acc[item.astype(np.int64) * nd + doc] = score
    if block is not None:
        terms, whose, repeats = plan.per_owner[s][group]
        m = 75 + (25 * lens * plan.n) // plan.length
        tf = block.tf.astype(np.int64)
        part = np.repeat(plan.weights[block.terms], block.counts) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[block.docs]))
        first = np.concatenate([[0], np.cumsum(block.counts)])
        at = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
        here = block.terms[at] == terms
        at, whose, repeats = at[here], whose[here], repeats[here]
        size = block.counts[at].astype(np.int64)
        where = K.take_ranges(first[at], size)
        np.add.at(acc, np.repeat(whose * nd, size) + block.docs[where], np.repeat(repeats, size) * part[where])
    grid = acc.reshape(n_items, nd)
    keep = grid > 0
    if nd > top:
        # the score that the block's 20th document has at least; later owners can add `rest` at most
        floor = np.partition(grid, nd - top, axis=1)[:, nd - top]
        first_item = group * BUNDLE_ITEMS
        keep &= grid + plan.rest[s, first_item:first_item + n_items][:, None] >= floor[:, None]
    i, d = np.nonzero(keep)
    return i, d, grid[i, d]


def pipeline(spark, table: DataFrame, plan: Plan, top: int = TOP) -> DataFrame:
    """``(item, doc_id, score)``: the highest ``top`` of each item and block (all that tie for the last place)."""
    shared = spark.sparkContext.broadcast(plan)
    n_groups = -(-plan.items // BUNDLE_ITEMS)
    shape = pa.schema([("block", pa.int64()), ("grp", pa.int32()), ("ids", pa.binary()), ("lens", pa.binary()), ("item", pa.binary()), ("doc", pa.binary()), ("score", pa.binary())])
    ddl = "block long, grp int, ids binary, lens binary, item binary, doc binary, score binary"
    empty = F.lit(b"")
    bundles = (table.filter("owner = -1").select("block", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("grp"), F.col("a").alias("ids"),
                                                 F.col("b").alias("lens"), empty.alias("item"), empty.alias("doc"), empty.alias("score")))

    def stage(s: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            plan = shared.value
            postings = None
            if right.num_rows:
                postings = Block(*(np.frombuffer(right.column(c)[0].as_py(), np.int32) for c in ("a", "b", "docs", "tf")))
            out = []
            for r in left.to_pylist():
                i, d, x = _add(plan, s, r["grp"], np.frombuffer(r["lens"], np.int64), np.frombuffer(r["item"], np.int32), np.frombuffer(r["doc"], np.int32),
                               np.frombuffer(r["score"], np.int64), postings, top)
                out.append(r | {"item": i.astype(np.int32).tobytes(), "doc": d.astype(np.int32).tobytes(), "score": x.tobytes()})
            return pa.Table.from_pylist(out, schema=shape)
        return run

    for s in range(OWNERS):
        owned = table.filter(F.col("owner") == s).select("block", "a", "b", "docs", "tf")
        bundles = bundles.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(stage(s), ddl)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                item = np.frombuffer(r["item"], np.int32) + r["grp"] * BUNDLE_ITEMS
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["doc"], np.int32)]),
                                                  pa.array(np.frombuffer(r["score"], np.int64))], ["item", "doc_id", "score"])

    return bundles.mapInArrow(emit, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP, part_words: int = ITEM_WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0.

    Equal scores go by ascending document id, a null id last.  Null and empty texts have no terms; an item without terms or hits,
    and empty tables, give no rows.  Every row of ``items`` is an item and every row of ``docs`` a document, so repeated rows give
    repeated results; other columns are not read.  Terms are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item_col].dataType.simpleString()
    out = []
    for part in item_parts(items, item_col, item_text, part_words):
        table = index(docs, part, id_col, text_col, block_rows)
        n, length = table.filter("owner = -1").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n:
            break
        found = pipeline(spark, table, _plan(part, n, length, _df(table, len(part.terms))), top)
        names = F.broadcast(spark.createDataFrame([(k, x) for k, x in enumerate(part.ids)], f"item int, item_id {kind}"))  # one part of the items
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        null = F.lit(int(np.iinfo(np.int64).max))
        out.append(written(ranked.join(names, "item").select("item_id", "rank", F.nullif("doc_id", null).alias("doc_id"), "score"), "search-result"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Registered query: the 20 documents that answer each benchmark item best."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*)::BIGINT AS qf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, len, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS len, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, s.n),
c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * s.n) // s.l))) AS x FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(x * qf)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM
(SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""
