"""Toxicity classifier: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text (``FEATURES``): densities and counts of lexicon words (a general seed list, and words and word
stems whose share of toxic learning rows is well above that of the others), lexicon words near a second person, rates of
capitals and punctuation, and of obfuscated spellings (words that are in the lexicon only after figures and signs are read as
letters, inner marks and stretched letters are undone and letters that stand apart are joined).

Learning uses at most about ``TRAIN_ROWS`` labelled rows (a documented bound; rows are chosen by a hash of their id).
Words and stems are counted in Spark; a row's features come from a lexicon that did not see its half of the rows, so that the
trees learn what the lexicon is worth on new texts.  The rows' feature vectors (numbers only) go through one task that
grows the trees on histograms; margins of rows left out in turn are calibrated by isotonic regression.  Lexicon, trees and
calibration are broadcast (all bounded), and scoring is one narrow pass over all whole texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markscope.llm import textkit as K
from markscope.llm.common import crc_mod, ship, written

U64 = np.uint64
TRAIN_ROWS = 12_000
LEXICON = 4000       # entries kept of each kind, the best first
LEAST_DOCS = 3       # toxic learning rows that an entry needs
LEAST_Z = 3.0        # log odds over their standard error
STEMS = (4, 5, 6)    # bytes
NEAR = 5             # words
TREES, DEPTH, BINS, RATE, RIDGE, FOLDS = 60, 3, 32, 0.15, 1.0, 5

#: A general list of insults, known beforehand and not taken from any data.
SEED_WORDS = """
arsehole asshole bastard bitch clown coward creep crap cretin degenerate disgusting dumb dumbass failure fool freak garbage
halfwit hate hideous idiot idiotic imbecile jerk kill liar loser lunatic maggot moron moronic nasty parasite pathetic pig rat
retard rubbish scum scumbag shit shut slut stupid sucker swine trash ugly useless vermin vile whore worthless
abschaum arschloch depp dumm dummkopf idioten miststück schwachkopf schwein trottel versager widerlich wertlos
abruti connard crétin imbécile merde ordure pourriture raclure salaud salope stupide
asqueroso basura cabrón escoria estúpido imbécil inútil mierda patético pendejo
""".split()
SECOND_PERSON = """you your yours yourself u ur ya du dich dir dein deine deinen ihr euch euer sie tu toi te ton ta tes vous votre vos
tú ti tus usted ustedes vosotros vuestro""".split()

FEATURES = ["seed_rate", "seed_count", "word_rate", "word_count", "stem_rate", "stem_count", "weight_rate", "weight_max", "you_rate",
            "near_you", "near_you_rate", "capital_rate", "shout_rate", "mark_rate", "exclaim_rate", "hidden_rate", "hidden_count", "mixed_rate",
            "stretched_rate", "masked_rate", "length"]

_CAPITAL = np.zeros(256, dtype=np.int64)
_CAPITAL[0x41:0x5B] = 1
_LETTER = _CAPITAL.copy()
_LETTER[0x61:0x7B] = 1
_LETTER[0x80:] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[0x30:0x3A] = 1
_MARK = ((K.TOKEN_KIND == 2) * 1).astype(np.int64)
_EXCLAIM = np.zeros(256, dtype=np.int64)
_EXCLAIM[[0x21, 0x3F]] = 1
_STAR = np.zeros(256, dtype=np.int64)
_STAR[[0x2A, 0x23, 0x24, 0x40]] = 1
#: Letters that figures and signs stand for; other marks vanish (0), white space stays.
_READ = K.LOWER.copy()
_READ[_MARK == 1] = 0
for _a, _b in zip(b"013457@$", b"oieastas"):
    _READ[_a] = _b


class Lexicon(NamedTuple):
    """Sorted hashes and their weights."""

    words: np.ndarray
    word_weight: np.ndarray
    stems: np.ndarray
    stem_weight: np.ndarray


def _hash_list(words: list[str]) -> np.ndarray:
    data, off = K.string_buffers(pa.array(words, pa.string()))
    return np.sort(K.word_hashes(data, off[:-1], off[1:]))


_SEEDS, _YOU = _hash_list(SEED_WORDS), _hash_list(SECOND_PERSON)


def _weights(h: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of each hash; 0 for those that are not in the list."""
    if len(keys) == 0 or len(h) == 0:
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, weights[at], 0.0)


def _stem_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each stem length the words that are longer, and the hashes of their stems."""
    for n in STEMS:
        at = np.flatnonzero(ends - starts > n)
        yield at, K.word_hashes(data, starts[at], starts[at] + n)


def _per_row(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values)])
    return c[ptr[1:]] - c[ptr[:-1]]


def _read_through(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with obfuscation undone; see the module's text."""
    read = _READ[data]
    n = len(data)
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = _LETTER[data[1:]] == 1
    bang = (data == 0x21) & follows
    read[bang] = 0x69
    keep = read != 0
    if n > 2:
        same = (read[1:] == read[:-1]) & (_LETTER[read[1:]] == 1)
        run = same[1:] & same[:-1]      # three equal letters in a row end at i + 2
        long_run = np.zeros(n, dtype=bool)
        for shift in (0, 1, 2):
            long_run[shift:n - 2 + shift] |= run
        first = np.ones(n, dtype=bool)
        first[1:] = ~same
        keep &= ~long_run | first
    starts, ends, ptr = K.word_bounds(data, off, K.SPACE_WORD)
    if len(starts) > 1:
        row = np.repeat(np.arange(len(off) - 1), np.diff(ptr))
        single = (ends - starts == 1) & (_LETTER[data[starts]] == 1)
        join = single[1:] & single[:-1] & (starts[1:] == ends[:-1] + 1) & (row[1:] == row[:-1])
        keep[ends[:-1][join]] = False
    at = np.concatenate([[0], np.cumsum(keep)])
    return read[keep], at[off]


def features(data: np.ndarray, off: np.ndarray, lex: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    n_rows = len(off) - 1
    starts, ends, ptr = K.word_bounds(data, off, K.ALNUM_WORD)
    n = np.diff(ptr)
    some, size = np.maximum(n, 1), np.maximum(np.diff(off), 1)
    h = K.word_hashes(data, starts, ends)
    seed = np.isin(h, _SEEDS)
    word = _weights(h, lex.words, lex.word_weight)
    stem = np.zeros(len(h))
    for at, sh in _stem_hashes(data, starts, ends):
        stem[at] = np.maximum(stem[at], _weights(sh, lex.stems, lex.stem_weight))
    you = np.isin(h, _YOU)
    hit = seed | (word > 0) | (stem > 0)
    near = np.zeros(len(h), dtype=bool)
    if len(h):
        row = np.repeat(np.arange(n_rows), n)
        yous = np.flatnonzero(you)
        hits = np.flatnonzero(hit)
        if len(yous) and len(hits):
            k = np.searchsorted(yous, hits)
            for other in (yous[np.minimum(k, len(yous) - 1)], yous[np.maximum(k - 1, 0)]):
                near[hits] |= (np.abs(other - hits) <= NEAR) & (row[other] == row[hits])
    weight = np.maximum(word, stem)
    top = np.zeros(n_rows)
    if len(h):
        full = n > 0
        top[full] = np.maximum.reduceat(weight, ptr[:-1][full])
    # rates over bytes
    def byte_rate(kind):
        return _per_row(kind[data], off) / size
    sums = {k: np.concatenate([[0], np.cumsum(v[data])]) for k, v in (("cap", _CAPITAL), ("let", _LETTER))}
    caps, letters = sums["cap"][ends] - sums["cap"][starts], sums["let"][ends] - sums["let"][starts]
    shout = (caps == ends - starts) & (ends - starts > 1)
    mixed = (letters > 0) & (letters < ends - starts)
    # obfuscation
    clear, clear_off = _read_through(data, off)
    cs, ce, cptr = K.word_bounds(clear, clear_off, K.SPACE_WORD)
    ch = K.word_hashes(clear, cs, ce)
    found = np.isin(ch, _SEEDS) | (_weights(ch, lex.words, lex.word_weight) > 0)
    hidden = np.maximum(_per_row(found, cptr) - _per_row(seed | (word > 0), ptr), 0)
    stretched = np.zeros(n_rows)
    if len(data) > 2:
        low = K.LOWER[data]
        three = np.zeros(len(data))
        three[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (_LETTER[data[2:]] == 1) & (data[2:] < 0x80)
        inside = np.repeat(np.arange(n_rows), np.diff(off))
        three[2:] *= inside[2:] == inside[:-2]
        stretched = _per_row(three, off)
    star = np.zeros(len(data))
    if len(data) > 2:
        star[1:-1] = (_STAR[data[1:-1]] == 1) & (_LETTER[data[:-2]] == 1) & (_LETTER[data[2:]] == 1)
    n_seed, n_word, n_stem, n_near = (_per_row(x, ptr) for x in (seed, word > 0, stem > 0, near))
    n_caps, n_let = _per_row(_CAPITAL[data], off), np.maximum(_per_row(_LETTER[data], off), 1)
    return np.stack([
        n_seed / some, np.log1p(n_seed), n_word / some, np.log1p(n_word), n_stem / some, np.log1p(n_stem),
        _per_row(weight, ptr) / some, top, _per_row(you, ptr) / some, np.log1p(n_near), n_near / some,
        n_caps / n_let, _per_row(shout, ptr) / some, byte_rate(_MARK), byte_rate(_EXCLAIM), hidden / some, np.log1p(hidden),
        _per_row(mixed, ptr) / some, stretched / some, _per_row(star, off) / some, np.log1p(n)], axis=1) if n_rows else np.zeros((0, len(FEATURES)))


class Model(NamedTuple):
    lexicon: Lexicon
    base: float
    trees: list
    knots: np.ndarray
    values: np.ndarray


def _margins(x: np.ndarray, base: float, trees: list) -> np.ndarray:
    """Sum of the leaves that each row reaches; a tree is (feature, threshold) per inner node in heap order, and leaves."""
    out = np.full(len(x), base)
    rows = np.arange(len(x))
    for feature, threshold, leaf in trees:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        out += leaf[node - (2 ** DEPTH - 1)]
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> tuple[float, list]:
    """Newton boosting of the logistic loss on histograms: the base margin and the trees."""
    ones = float(np.sum(y))
    base = float(np.log((ones + 1) / (len(y) - ones + 1)))
    out: list = []
    if ones in (0.0, float(len(y))):
        return base, out
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(f)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    # also cut between the lowest value and all others: rare features are mostly zero
    low = x.min(axis=0)
    for j in range(f):
        if len(edges[j]) == 0 or edges[j][0] > low[j]:
            edges[j] = np.concatenate([[low[j]], edges[j]])
            bins[:, j] = np.searchsorted(edges[j], x[:, j], side="left")
    flat = bins + BINS * np.arange(f)
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, hess = p - y, p * (1 - p)
        feature = np.zeros(2 ** DEPTH - 1, dtype=np.int64)
        threshold = np.full(2 ** DEPTH - 1, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            wide, first = 2 ** level, 2 ** level - 1
            key = ((node - first)[:, None] * (f * BINS) + flat).ravel()
            shape = (wide, f, BINS)
            gs = np.bincount(key, np.repeat(g, f), wide * f * BINS).reshape(shape).cumsum(axis=2)
            hs = np.bincount(key, np.repeat(hess, f), wide * f * BINS).reshape(shape).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs ** 2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt ** 2 / (ht + RIDGE)
            gain = gain.reshape(wide, -1)
            best = gain.argmax(axis=1)
            for k in range(wide):
                if gain[k, best[k]] > 1e-9:
                    j, b = divmod(int(best[k]), BINS)
                    if b < len(edges[j]):
                        feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - (2 ** DEPTH - 1)
        leaf = -RATE * np.bincount(at, g, 2 ** DEPTH) / (np.bincount(at, hess, 2 ** DEPTH) + RIDGE)
        margin += leaf[at]
        out.append((feature, threshold, leaf))
    return base, out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing fit of y on x, as knots for linear interpolation."""
    if len(x) == 0:
        return np.array([0.0]), np.array([0.5])
    xs, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []      # mean, weight, first x, last x
    for a, w, at in zip(mean, weight, xs):
        blocks.append([a, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            a2, w2, _, hi = blocks.pop()
            a1, w1, lo, _ = blocks.pop()
            blocks.append([(a1 * w1 + a2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    return (np.array([v for b in blocks for v in (b[2], b[3])]), np.array([v for b in blocks for v in (b[0], b[0])]))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list, np.ndarray, np.ndarray]:
    """Trees on all rows; calibration on margins of rows that were left out in turn (rows come in hash order)."""
    fold = np.arange(len(y)) % FOLDS
    left_out = np.zeros(len(y))
    for k in range(FOLDS):
        left_out[fold == k] = _margins(x[fold == k], *grow(x[fold != k], y[fold != k]))
    knots, values = isotonic(left_out, y)
    return (*grow(x, y), knots, values)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int, fold) -> DataFrame:
    """``(y, at, t)`` of at most about ``train_rows`` labelled ids; one row for each id, whatever repeats."""
    seen = (labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
            .filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & fold(F.col("k")))
            .groupBy("k").agg(F.max("y").alias("y")).withColumn("at", F.xxhash64("k", F.lit(12))))
    n = seen.count()
    if n > train_rows:
        seen = seen.filter(F.pmod("at", F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    # about train_rows ids, whatever the corpus: this broadcast is bounded
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(seen), F.col("id") == F.col("k"))
    return rows.groupBy("at", "y", "k").agg(F.min("t").alias("t")).select("y", "at", "t")


def _lexica(sample: DataFrame) -> list[Lexicon]:
    """Lexica of the rows outside half 0, outside half 1, and of all rows."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = (np.array(b.column(1).to_pylist(), dtype=np.int64) & 1) * 2 + np.array(b.column(0).to_pylist(), dtype=np.int64)
            data, off = K.string_buffers(b.column(2))
            for i, j in K.slices(off):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                starts, ends, ptr = K.word_bounds(d, o, K.ALNUM_WORD)
                row = np.repeat(np.arange(j - i), np.diff(ptr))
                for kind, at, h in [(0, np.arange(len(starts)), K.word_hashes(d, starts, ends)), *((1, *s) for s in _stem_hashes(d, starts, ends))]:
                    order = np.lexsort((row[at], h))
                    hs, rs = h[order], row[at][order]
                    new = np.ones(len(hs), dtype=bool)
                    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])     # once for each text
                    hs, gs = hs[new], group[i:j][rs[new]]
                    keys, where = np.unique(hs, return_inverse=True)
                    counts = np.bincount(where * 4 + gs, minlength=4 * len(keys)).reshape(-1, 4) if len(keys) else np.zeros((0, 4), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)),
                                                      *(pa.array(counts[:, c].astype(np.int64)) for c in range(4))], ["kind", "h", "n0", "n1", "n2", "n3"])

    counts = sample.select("y", "at", "t").mapInArrow(entries, "kind int, h long, n0 long, n1 long, n2 long, n3 long")
    counts = counts.groupBy("kind", "h").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in range(4)))
    size = {(r["s"], r["y"]): r["n"] for r in sample.groupBy((F.col("at").bitwiseAND(F.lit(1))).alias("s"), "y").agg(F.count("*").alias("n")).collect()}
    out = []
    for halves in ([1], [0], [0, 1]):
        pos, neg = (sum((F.col(f"n{2 * s + y}") for s in halves), F.lit(0)) for y in (1, 0))
        n_pos, n_neg = (sum(size.get((s, y), 0) for s in halves) for y in (1, 0))
        odds = F.log((pos + 0.5) / (n_pos - pos + 0.5)) - F.log((neg + 0.5) / (n_neg - neg + 0.5))
        z = odds / F.sqrt(1 / (pos + 0.5) + 1 / (n_pos - pos + 0.5) + 1 / (neg + 0.5) + 1 / (n_neg - neg + 0.5))
        arrays = []
        for kind in (0, 1):
            best = (counts.filter((F.col("kind") == kind) & (pos >= LEAST_DOCS)).select("h", odds.alias("w"), z.alias("z"))
                    .filter((F.col("w") > 1) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "h").limit(LEXICON))
            got = best.collect()    # LEXICON rows at most
            h = np.array([r["h"] for r in got], dtype=np.int64).view(U64)
            w = np.array([r["w"] for r in got], dtype=float)
            order = np.argsort(h)
            arrays += [h[order], w[order]]
        out.append(Lexicon(*arrays))
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          train_rows: int = TRAIN_ROWS, fold=lambda k: crc_mod(k, 3) != 1) -> Model:
    """The model from at most about ``train_rows`` labelled rows of the folds for which ``fold(id)`` holds.

    An id with several labels is toxic if one says so; of several texts the smallest counts.
    """
    spark = docs.sparkSession
    ship(spark)
    sample = written(_sample(docs, labels, id_col, text_col, label_col, train_rows, fold), "toxicity-rows")
    lexica = _lexica(sample)
    shared = spark.sparkContext.broadcast(lexica)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array(b.column(1).to_pylist(), dtype=np.int64)
            data, off = K.string_buffers(b.column(2))
            for i, j in K.slices(off):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                both = [features(d, o, shared.value[k]) for k in (0, 1)]
                mine = np.where((at[i:j] & 1)[:, None] == 0, both[0], both[1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                                                  pa.array([r.tobytes() for r in mine], pa.binary())], ["y", "at", "x"])

    def boost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, xs = [], []
        for b in batches:
            ys += b.column(0).to_pylist()
            xs += [np.frombuffer(v) for v in b.column(2).to_pylist()]
        x = np.stack(xs) if xs else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, np.array(ys, dtype=float)))], pa.binary())], ["model"])

    numbers = sample.mapInArrow(vectors, "y int, at long, x binary")
    got = numbers.repartition(1).sortWithinPartitions("at", "y", "x").mapInArrow(boost, "model binary").collect()
    # one row of some 60 trees (none came if there was no row)
    parts = pickle.loads(got[0]["model"]) if got else fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return Model(lexica[2], *parts)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score (0 to 1) as the last column ``name``; it replaces one of that name."""
    spark = docs.sparkSession
    ship(spark)
    if name in docs.columns and name != text_col:
        docs = docs.drop(name)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off = K.string_buffers(b.column(at))
            for i, j in K.slices(off):
                x = features(data[off[i]:off[j]], off[i:j + 1] - off[i], m.lexicon)
                s = np.interp(_margins(x, m.base, m.trees), m.knots, m.values)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), pa.array(s)], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op12_toxicity_gbt(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document's calibrated score and class.

    Null and empty texts have a vector of zeros.  Without labels every score is 0.5.  A null doc_id is not held out; repeated
    rows are scored each; the tables' other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))
