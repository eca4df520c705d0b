"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text, hashed into ``DIM`` slots: its tokens (runs of letters and digits, runs of other marks, case
kept), token pairs, and pairs and triples of token shapes (case pattern, length class, repeat of an earlier token).
A feature's value is its share of the text's tokens, so a score is one sparse dot product, a mean of weights.

Training uses at most about ``TRAIN_ROWS`` labelled rows (a documented bound; rows are chosen by a hash
of their id, evenly over the corpus).  Their labels are few and known to be, so they are broadcast to the scan; the
sparse rows go in hash order through one task that runs the FTRL-proximal updates.  The weights
(``DIM`` numbers at most) are broadcast, and scoring is one narrow pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscope.llm import textkit as K
from markscope.llm.common import crc_mod, ship, written

U64 = np.uint64
DIM_BITS = 18
DIM = 1 << DIM_BITS
TRAIN_ROWS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-6
SCALE = 32.0
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[0x41:0x5B] = 1
_STEP = [U64(K._mix_int(7100 + i) | 1) for i in range(6)]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(slots, row, n)``: the slot of every feature occurrence, its row, and each row's number of tokens."""
    starts, ends, ptr = K.word_bounds(data, off, K.TOKEN_KIND)
    h = K.word_hashes(data, starts, ends, K.CASE_VALUE)
    n = np.diff(ptr)
    row = np.repeat(np.arange(len(n)), n)
    if len(h) == 0:
        return np.zeros(0, np.int64), row, n
    size = ends - starts
    up = np.concatenate([[0], np.cumsum(_UPPER[data])])
    n_up = up[ends] - up[starts]
    case = np.where(n_up == 0, 0, np.where(n_up == size, 2, np.where((n_up == 1) & (_UPPER[data[starts]] == 1), 1, 3)))
    shape = (case * 8 + np.minimum(size // 3, 7)).astype(U64)
    marks = K.TOKEN_KIND[data[starts]] == 2
    shape[marks] = h[marks] | U64(1 << 63)
    for back in (1, 2):
        same = np.zeros(len(h), dtype=bool)
        same[back:] = (h[back:] == h[:-back]) & (row[back:] == row[:-back])
        shape[same] += U64(64 * back)
    shape = K.mix(shape)
    groups = [(h, row)]
    if len(h) > 1:
        two = row[1:] == row[:-1]
        groups += [((h[:-1] * _STEP[0] + h[1:])[two], row[1:][two]), ((shape[:-1] * _STEP[1] + shape[1:])[two], row[1:][two])]
    if len(h) > 2:
        three = row[2:] == row[:-2]
        groups.append((((shape[:-2] * _STEP[2] + shape[1:-1]) * _STEP[3] + shape[2:])[three], row[2:][three]))
    slots = np.concatenate([K.mix(g) >> U64(64 - DIM_BITS) for g, _ in groups]).astype(np.int64)
    return slots, np.concatenate([r for _, r in groups]), n


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over ``(slots, values, label)``; returns the weights and the bias."""
    z, s = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(s[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) > L1, w, 0.0)

    for _ in range(epochs):
        for slots, values, label in rows:
            i = np.append(slots, DIM)
            x = np.append(values, 1.0)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(np.dot(w, x), -35, 35)))
            g = (p - label) * x
            root = np.sqrt(s[i])
            s[i] += g * g
            z[i] += g - (np.sqrt(s[i]) - root) / ALPHA * w
    w = weights(np.arange(DIM + 1))
    return w[:DIM], float(w[DIM])


def scores(data: np.ndarray, off: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    slots, row, n = features(data, off)
    dot = np.bincount(row, weights=w[slots], minlength=len(n)) if len(slots) else np.zeros(len(n))
    return 1.0 / (1.0 + np.exp(-np.clip(bias + SCALE * dot / np.maximum(n, 1), -35, 35)))


def sparse_rows(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct slots and values."""
    slots, row, n = features(data, off)
    order = np.argsort(row, kind="stable")
    slots = slots[order]
    cut = np.searchsorted(row[order], np.arange(len(n) + 1))
    for r in range(len(n)):
        s, c = np.unique(slots[cut[r]:cut[r + 1]], return_counts=True)
        yield s.astype(np.int32), (SCALE * c / max(n[r], 1)).astype(np.float32)


def _labelled(labels: DataFrame, id_col: str, label_col: str, train_rows: int, fold) -> DataFrame:
    """At most about ``train_rows`` labelled ids of the learning folds: ``(k, y, at)``, chosen by hash."""
    seen = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter(
        F.col("k").isNotNull() & F.col("y").isin(0, 1) & fold(F.col("k"))).distinct().withColumn("at", F.xxhash64("k", F.lit(3)))
    n = seen.count()
    if n <= train_rows:
        return seen
    return seen.filter(F.pmod("at", F.lit(1_000_000)) < int(1_000_000 * train_rows / n))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          train_rows: int = TRAIN_ROWS, fold=lambda k: crc_mod(k, 3) != 1) -> tuple[np.ndarray, float]:
    """Weights and bias from at most about ``train_rows`` labelled rows of the folds for which ``fold(id)`` holds."""
    spark = docs.sparkSession
    ship(spark)
    # the bound is train_rows, so this broadcast has a size of its own, whatever the corpus
    some = F.broadcast(_labelled(labels, id_col, label_col, train_rows, fold))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = K.string_buffers(b.column(2))
            for i, j in K.slices(off):
                got = list(sparse_rows(data[off[i]:off[j]], off[i:j + 1] - off[i]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([s.tobytes() for s, _ in got], pa.binary()),
                     pa.array([v.tobytes() for _, v in got], pa.binary())], ["at", "y", "s", "v"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            for y, s, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                got.append((np.frombuffer(s, dtype=np.int32), np.frombuffer(v, dtype=np.float32), y))
        w, bias = train(got)
        slots = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, DIM)), pa.array(np.append(w[slots], bias))], ["slot", "w"])

    sparse = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(some, F.col("id") == F.col("k"))
              .groupBy("at", "y").agg(F.min("t").alias("t")).mapInArrow(rows, "at long, y int, s binary, v binary"))   # one text an id
    kept = written(sparse, "quality-rows")
    model = kept.repartition(1).sortWithinPartitions("at", "y", "s").mapInArrow(fit, "slot long, w double")
    w, bias = np.zeros(DIM, dtype=np.float64), 0.0
    for slot, x in model.collect():  # DIM + 1 rows at most
        if slot == DIM:
            bias = x
        else:
            w[slot] = x
    return w, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score (0 to 1) as the last column ``name``; it replaces one of that name."""
    spark = docs.sparkSession
    ship(spark)
    if name in docs.columns and name != text_col:
        docs = docs.drop(name)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in batches:
            data, off = K.string_buffers(b.column(at))
            for i, j in K.slices(off):
                s = scores(data[off[i]:off[j]], off[i:j + 1] - off[i], w, bias)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), pa.array(s)], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op3_quality_ftrl(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document's score and class.

    Null and empty texts have no features: their score is the bias's.  Without labels every score is 0.5.  A null doc_id
    is not held out; repeated rows are scored each; tables' other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
