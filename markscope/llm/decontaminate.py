"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window).  From both
sides the minimum ``k``-gram hash of every sliding window of ``WINDOW - k + 1`` grams is kept, so any
shared span of ``WINDOW`` words keeps at least one common fingerprint; items shorter than ``WINDOW`` words
form a class of their own length, with ``k`` and the sliding window cut to fit.  Document fingerprints are
joined with the item fingerprints, and every hit is extended word by word to both sides; a hit
counts once it spans a whole window.

The benchmark is the stated query set: it is held against all documents in blocks of at most
``BLOCK_WORDS`` words (checked; one item at least).  A block's fingerprints go to the tasks as one broadcast of
bounded size, and each further block is one more narrow pass, so the documents are never shuffled
and a passage that many documents share costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm import textkit as K
from markscope.llm.common import running_parts, ship, written

U64 = np.uint64
WINDOW = 10
GRAM = 5
COPIES = 10_000
BLOCK_WORDS = 4_000_000
#: Chained passes before the running result is written and read back.
PASSES = 4
_STEP = U64(K._mix_int(31) | 1)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (positions near the end hold rubbish)."""
    g = h.copy()
    for j in range(1, k):
        g[:-j] = g[:-j] * _STEP + h[j:] if j < len(h) else g[:-j]
    return K.mix(g) | U64(1)


def winnow(h: np.ndarray, ptr: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are a minimum of some whole window.

    ``ptr``: each row's first word.  A window is ``window`` words: ``window - k + 1`` grams.
    """
    n, w = len(h), window - k + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g = _grams(h, k)
    low = g[: n - window + 1].copy()
    for j in range(1, w):
        np.minimum(low, g[j: j + len(low)], out=low)
    # windows that cross the end of a row never count
    left = np.repeat(ptr[1:], np.diff(ptr))[: len(low)] - np.arange(len(low))
    low[left < window] = 0
    keep = np.zeros(n, dtype=bool)
    for j in range(w):
        keep[j: j + len(low)] |= g[j: j + len(low)] == low
    at = np.flatnonzero(keep)
    return at, g[at]


class Block:
    """Fingerprints of some items, ready to be searched by tasks."""

    def __init__(self, ids: list[list[str]], hashes: list[np.ndarray], window: int = WINDOW, gram: int = GRAM):
        self.ids = ids      # of each text
        lens = np.array([len(x) for x in hashes], dtype=np.int64)
        self.words = np.concatenate(hashes) if len(hashes) else np.zeros(0, U64)
        self.first = np.cumsum(lens) - lens
        self.classes = []
        for size in np.unique(np.minimum(lens, window)):
            if size == 0:
                continue
            pick = np.flatnonzero(np.minimum(lens, window) == size)
            part = np.concatenate([hashes[i] for i in pick])
            ptr = np.concatenate([[0], np.cumsum(lens[pick])])
            k = min(gram, int(size))
            at, g = winnow(part, ptr, k, int(size))
            row = np.searchsorted(ptr, at, side="right") - 1
            where = self.first[pick[row]] + at - ptr[row]
            order = np.argsort(g, kind="stable")
            keys, start = np.unique(g[order], return_index=True)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[keys >> U64(48)] = True
            self.classes.append((int(size), k, keys, np.append(start, len(g)), where[order], pick[row][order], seen))
        self.last = self.first + lens

    def search(self, h: np.ndarray, ptr: np.ndarray, pairs_at_once: int = 1 << 19):
        """Yields (starts, ends, items): spans of document words that equal item words."""
        row_of = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        for size, k, keys, start, where, item, seen in self.classes:
            at, g = winnow(h, ptr, k, size)
            some = seen[g >> U64(48)]
            at, g = at[some], g[some]
            j = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            some = keys[j] == g
            at, j = at[some], j[some]
            many = start[j + 1] - start[j]
            done = np.cumsum(many)
            a = 0
            while a < len(at):
                base = done[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(done, base + pairs_at_once, side="right")))
                p = np.repeat(at[a:b], many[a:b])
                post = K.take_ranges(start[j[a:b]], many[a:b])
                yield self._extend(h, ptr, row_of, p, where[post], item[post], size, k)
                a = b

    def _extend(self, h, ptr, row_of, p, q, item, size, k):
        same = np.ones(len(p), dtype=bool)
        for j in range(k):
            same &= h[p + j] == self.words[q + j]
        p, q, item = p[same], q[same], item[same]
        row = row_of[p]
        left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        go_l, go_r = np.ones(len(p), bool), np.ones(len(p), bool)
        for j in range(1, size - k + 1):
            go_l &= (p - j >= ptr[row]) & (q - j >= self.first[item])
            go_l[go_l] = h[p[go_l] - j] == self.words[q[go_l] - j]
            left += go_l
            e, f = p + k + j - 1, q + k + j - 1
            go_r &= (e < ptr[row + 1]) & (f < self.last[item])
            go_r[go_r] = h[e[go_r]] == self.words[f[go_r]]
            right += go_r
        whole = left + k + right >= size
        return (p - left)[whole], (p + k + right)[whole], item[whole]


def _item_hashes(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = K.string_buffers(b.column(1))
            for i, j in K.slices(off):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                starts, ends, ptr = K.word_bounds(d, o, K.ALNUM_WORD)
                h = K.word_hashes(d, starts, ends)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([h[ptr[r]:ptr[r + 1]].tobytes() for r in range(j - i)], pa.binary())],
                    ["id", "h"])

    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                            F.col(text_col).alias("t")).mapInArrow(run, "id string, h binary")


def _pass(rows: DataFrame, block) -> DataFrame:
    """Add one block's hits to ``(id, t, n_words, spans, items, n_hit)``."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.value
        for b in batches:
            data, off = K.string_buffers(b.column(1))
            for i, j in K.slices(off):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                starts, ends, ptr = K.word_bounds(d, o, K.ALNUM_WORD)
                h = K.word_hashes(d, starts, ends)
                cover = np.zeros(len(h) + 1, dtype=np.int32)
                found: dict[int, set] = {}
                for s, e, item in index.search(h, ptr):
                    np.add.at(cover, s, 1)
                    np.add.at(cover, e, -1)
                    row = np.searchsorted(ptr, s, side="right") - 1
                    for r, x in np.unique(np.stack([row, item], axis=1), axis=0).tolist():
                        found.setdefault(r, set()).update(index.ids[x])
                part = b.slice(i, j - i)
                old_spans, old_items, n_hit = part.column(3), part.column(4), part.column(5)
                if found:
                    deep = np.cumsum(cover)[:-1]
                    spans, items, counts = old_spans.to_pylist(), old_items.to_pylist(), n_hit.to_pylist()
                    for r, names in found.items():
                        hit = deep[ptr[r]:ptr[r + 1]] > 0
                        for k in range(0, len(spans[r]), 2):
                            hit[spans[r][k]:spans[r][k + 1]] = True
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                        spans[r] = edge.tolist()
                        counts[r] = int(hit.sum())
                        items[r] = sorted(names | set(items[r]))
                    old_spans, old_items = pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))
                    n_hit = pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(ptr)), old_spans, old_items, n_hit],
                    ["id", "t", "n_words", "spans", "items", "n_hit"])

    return rows.mapInArrow(run, schema)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS,
           window: int = WINDOW, gram: int = GRAM) -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_words`` words and ids (or one item), one at a time on the driver.

    Items of equal words are one, with all their ids; a text of very many ids is several, of at most about ``COPIES`` ids each.
    """
    ship(benchmark.sparkSession)
    items = written(_item_hashes(benchmark, id_col, text_col).filter(F.length("h") > 0).distinct(), "decontaminate-items")
    many = items.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / COPIES).alias("n")).filter("n > 1").withColumnRenamed("h", "mh")
    folded = (items.join(many, F.col("h") == F.col("mh"), "left").groupBy("h", F.coalesce(F.pmod(F.xxhash64("id"), F.col("n")), F.lit(0)).alias("salt"))
              .agg(F.sort_array(F.collect_set("id")).alias("ids")).select("h", "ids", (F.expr("length(h) div 8") + F.size("ids")).alias("weight")))
    parts = running_parts(written(folded, "decontaminate-texts"), "weight", block_words)
    names = sorted(r["part"] for r in parts.select("part").distinct().collect())
    if not names:
        yield Block([], [], window, gram)
    for name in names:
        got = parts.filter(F.col("part") == name).select("h", "ids").orderBy("h", "ids").collect()
        yield Block([r["ids"] for r in got], [np.frombuffer(r["h"], dtype=U64) for r in got], window, gram)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
                  window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """``(id, n_words, spans, items, n_hit)`` for every row of ``docs`` (with ``t`` if ``keep_text``).

    spans: hit words as start, end, start, end ...; items: sorted ids (as strings) of the items with a window
    in the text.  Null and empty texts and items have no words; an empty benchmark hits nothing; items with
    equal ids count once, a null item id is the empty string; repeated rows and null ids stay as they
    are; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.lit(0).cast("long").alias("n_words"),
                       F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_hit"))
    for n, block in enumerate(blocks(benchmark, item_col, item_text, block_words, window, gram)):
        if n and n % PASSES == 0:
            rows = written(rows, "decontaminate")
        rows = _pass(rows, spark.sparkContext.broadcast(block))
    return rows if keep_text else rows.drop("t")


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they are."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    return decontaminate(whole, benchmark, "row", "text").filter("n_hit = 0").select("id.*")


def op1_decontaminate_winnowing(spark, sf_dir: str) -> DataFrame:
    """Registered query: hit words and items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, bench).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN sizes ON len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.p, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit
          FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
