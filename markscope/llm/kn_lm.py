"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays, memory-mapped for scoring.

Files of a model, all in one folder of the shared mount (``spark.checkpoint.dir``), dealt over shards whose number grows
with the corpus, so no task holds more than a bounded part:

* ``vocab-i``: sorted 64-bit word hashes of one range of the hash space, with their counts.  A word's number is its rank.
* ``pairs-i``: sorted keys ``context number << 32 | word number`` of the pairs that hash to shard i, with their counts.
* ``words-i``: for a range of word numbers the context's total, its words seen once, twice and more often, and
  the number of contexts that the word follows.

Counting: each task folds its texts to distinct keys with counts before the shuffle, so a hot word costs one entry per
task; shards merge sorted arrays.  Pairs are dealt by a hash of the whole pair, not by context, so a frequent context spreads
over all shards; its statistics meet as partial sums.  Files are written under a temporary name and renamed, with the same
content on every attempt, so lost executors only mean that a shard is made again.

Scoring is one narrow pass: a task looks up the distinct words and pairs of a slice of texts in the mapped files.  Its
memory is the slice's; the pages that it touches belong to the system's cache.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm import textkit as K
from markscope.llm.common import crc_mod, shared_path, ship
from markscope.llm.kneser_ney import discount_of, discounts

U64 = np.uint64
END = U64(K._mix_int(424242))
VOCAB_SHARD_BYTES = 64 << 20  # text bytes a vocabulary shard
PAIR_SHARD_TOKENS = 2_000_000
WORD_SHARD_WORDS = 400_000
FOLD_AT = 2_000_000


def mounted(path: str) -> str:
    """The shared folder as workers open it: a mount (``file:`` or a plain path)."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise RuntimeError("the language model's folder (spark.checkpoint.dir) must be on a mount that workers can map")
    return path


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    for k, a in arrays.items():
        part = os.path.join(folder, f".{name}.{k}.{os.getpid()}.tmp")
        a.tofile(part)
        os.replace(part, os.path.join(folder, f"{name}.{k}"))


def _map(folder: str, name: str, kind) -> np.ndarray:
    path = os.path.join(folder, name)
    return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)


def planes(a: np.ndarray) -> bytes:
    """Bytes by significance: the shuffle's compression drops the high ones that are all zero."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Fold:
    """Collects keys with counts, folding now and then so that memory is that of the distinct ones."""

    def __init__(self):
        self.keys, self.counts, self.size, self.limit = [], [], 0, FOLD_AT

    def add(self, keys, counts):
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.size += len(keys)
        if self.size > self.limit:
            k, c = self.take()
            self.keys, self.counts, self.size = [k], [c], len(k)
        return self.size > FOLD_AT  # too many distinct keys: time to hand them on

    def take(self):
        k, c = fold(np.concatenate(self.keys) if self.keys else np.zeros(0, U64), np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64))
        self.keys, self.counts, self.size = [], [], 0
        return k, c


def _dealt(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(shard, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.searchsorted(shard[order], np.arange(n + 1))
    some = np.flatnonzero(np.diff(cut))
    for at in range(0, len(some), 64):
        part = some[at:at + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array([planes(np.diff(keys[cut[s]:cut[s + 1]], prepend=U64(0))) for s in part], pa.binary()),
             pa.array([planes(counts[cut[s]:cut[s + 1]]) for s in part], pa.binary())], ["shard", "k", "c"])


def _undealt(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.cumsum(unplanes(b, U64), dtype=U64) for b in table.column("k").to_pylist()]
    return fold(np.concatenate(keys), np.concatenate([unplanes(b, np.int64) for b in table.column("c").to_pylist()]))


def _shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and then the end, and each row's first token."""
    starts, ends, ptr = K.word_bounds(data, off, K.SPACE_WORD)
    h = K.word_hashes(data, starts, ends)
    rows = len(off) - 1
    out = np.full(len(h) + rows, END, dtype=U64)
    out[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(ptr))] = h
    return out, ptr + np.arange(rows + 1)


class Tables:
    """The mapped files of a model."""

    def __init__(self, folder: str, first: np.ndarray, n_pairs: int = 0, word_step: int = 1, n_words: int = 0):
        self.folder, self.first, self.n_vocab = folder, first, len(first) - 1
        self.size = int(first[-1])  # the vocabulary; also the number of the context "start of text"
        self.n_pairs, self.word_step, self.n_words = n_pairs, word_step, n_words
        self.vocab = [(_map(folder, f"vocab-{i}.k", U64), _map(folder, f"vocab-{i}.c", np.int64)) if first[i + 1] > first[i] else None for i in range(self.n_vocab)]
        self.pairs = [self._pair(i) for i in range(n_pairs)]
        self.words = [_map(folder, f"words-{i}.s", np.int64).reshape(-1, 5) if os.path.exists(os.path.join(folder, f"words-{i}.s")) else None for i in range(n_words)]

    def _pair(self, i):
        if not os.path.exists(os.path.join(self.folder, f"pairs-{i}.k")):
            return None
        return tuple(_map(self.folder, f"pairs-{i}.{x}", t) for x, t in (("k", U64), ("c", np.uint8), ("at", np.int64), ("big", np.int64)))

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: not in the vocabulary) and count of each of some sorted distinct hashes."""
        num, count = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        cut = np.searchsorted(_shard_of(h, self.n_vocab), np.arange(self.n_vocab + 1))
        for i, t in enumerate(self.vocab):
            a, b = cut[i], cut[i + 1]
            if t is None or a == b:
                continue
            at = np.minimum(np.searchsorted(t[0], h[a:b]), len(t[0]) - 1)
            hit = np.flatnonzero(t[0][at] == h[a:b])
            num[a + hit] = self.first[i] + at[hit]
            count[a + hit] = t[1][at[hit]]
        return num, count

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of some sorted distinct keys."""
        out = np.zeros(len(keys), dtype=np.int64)
        shard = _shard_of(K.mix(keys), self.n_pairs)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.n_pairs + 1))
        for i, t in enumerate(self.pairs):
            own = order[cut[i]:cut[i + 1]]
            if t is None or not len(own):
                continue
            k, c, at_big, big = t
            at = np.minimum(np.searchsorted(k, keys[own]), len(k) - 1)
            got = np.where(k[at] == keys[own], c[at].astype(np.int64), 0)
            more = np.flatnonzero(got == 255)
            if len(more):
                got[more] = big[np.searchsorted(at_big, at[more])]
            out[own] = got
        return out

    def word_stats(self, num: np.ndarray) -> np.ndarray:
        """The five statistics of each number (zeros for -1); numbers in any order."""
        out = np.zeros((len(num), 5), dtype=np.int64)
        shard = np.where(num >= 0, num // self.word_step, -1)
        for i in np.unique(shard).tolist():
            if 0 <= i < len(self.words) and self.words[i] is not None:
                own = np.flatnonzero(shard == i)
                out[own] = self.words[i][num[own] - i * self.word_step]
        return out


_OPEN: dict = {}


def _open(spec: tuple) -> Tables:
    """A worker maps a model's files once."""
    if spec not in _OPEN:
        _OPEN.clear()
        folder, first, *rest = spec
        _OPEN[spec] = Tables(folder, np.frombuffer(first, dtype=np.int64), *rest)
    return _OPEN[spec]


class Model:
    """What the driver knows of a model: where it is and a few totals."""

    def __init__(self, folder, first, n_tokens, n_pairs=0, word_step=1, n_words=0, d2=(0.5, 1.0, 1.5), d1=(0.5, 1.0, 1.5), cont=(0, 0, 0), types=0):
        self.spec = (folder, np.asarray(first, dtype=np.int64).tobytes(), n_pairs, word_step, n_words)
        self.n_tokens, self.n_types = int(n_tokens), int(first[-1])
        self.d2, self.d1, self.cont, self.types = d2, d1, cont, types

    def p_word(self, follows: np.ndarray) -> np.ndarray:
        """Continuation probability, interpolated with a uniform one over the vocabulary and one unknown word."""
        if not self.types:
            return np.full(len(follows), 1.0 / (self.n_types + 1))
        left = float(np.dot(self.d1, self.cont)) / self.types
        return (follows - discount_of(follows, self.d1)) / self.types + left / (self.n_types + 1)

    def p_pair(self, c: np.ndarray, ctx: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Probability of a word with pair count ``c`` after a context with statistics ``ctx``."""
        low = self.p_word(follows)
        total = np.maximum(ctx[:, 0], 1)
        left = (ctx[:, 1] * self.d2[0] + ctx[:, 2] * self.d2[1] + ctx[:, 3] * self.d2[2]) / total
        return np.where(ctx[:, 0] > 0, (c - discount_of(c, self.d2)) / total + left * low, low)


def _numbered(t: Tables, data: np.ndarray, off: np.ndarray):
    """``(distinct hashes' numbers, their counts, token -> distinct, first token of each row, pair contexts)``."""
    h, ptr = tokens(data, off)
    words, of = np.unique(h, return_inverse=True)
    num, count = t.numbers(words)
    ctx = np.empty(len(h), dtype=np.int64)
    ctx[1:] = num[of[:-1]]
    ctx[ptr[:-1]] = t.size  # the start of the text
    return num, count, of, ptr, ctx


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count a corpus; null text is empty (one end token)."""
    spark = docs.sparkSession
    ship(spark)
    folder = mounted(shared_path(spark, "lm"))
    texts = docs.select(F.col(text_col).alias("t"))
    n_vocab = int(max(4, (texts.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0) // VOCAB_SHARD_BYTES))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Fold()
        for b in batches:
            data, off = K.string_buffers(b.column(0))
            for i, j in K.slices(off):
                h, _ = tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])
                if held.add(*np.unique(h, return_counts=True)):
                    k, c = held.take()
                    yield from _dealt(k, c, _shard_of(k, n_vocab), n_vocab)
        k, c = held.take()
        yield from _dealt(k, c, _shard_of(k, n_vocab), n_vocab)

    def merge_words(table: pa.Table) -> pa.Table:
        i = table.column("shard")[0].as_py()
        k, c = _undealt(table)
        _save(folder, f"vocab-{i}", k=k, c=c)
        return pa.table({"shard": pa.array([i], pa.int32()), "n": [len(k)], "total": [int(c.sum())]})

    dealt = texts.mapInArrow(count_words, "shard int, k binary, c binary")
    sizes, n_tokens = np.zeros(n_vocab, dtype=np.int64), 0
    for r in dealt.groupBy("shard").applyInArrow(merge_words, "shard int, n long, total long").collect():  # one row a shard
        sizes[r["shard"]] = r["n"]
        n_tokens += r["total"]
    first = np.concatenate([[0], np.cumsum(sizes)])
    if not n_tokens:
        return Model(folder, first, 0)
    n_pairs = int(max(8, n_tokens // PAIR_SHARD_TOKENS))
    n_words = int(max(1, (first[-1] + 1) // WORD_SHARD_WORDS))
    step = int(first[-1] // n_words) + 1
    spec = (folder, first.tobytes())

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held = _open(spec), _Fold()
        for b in batches:
            data, off = K.string_buffers(b.column(0))
            for i, j in K.slices(off):
                num, _, of, _, ctx = _numbered(t, data[off[i]:off[j]], off[i:j + 1] - off[i])
                if held.add(*np.unique(ctx.astype(U64) << U64(32) | num[of].astype(U64), return_counts=True)):
                    k, c = held.take()
                    yield from _dealt(k, c, _shard_of(K.mix(k), n_pairs), n_pairs)
        k, c = held.take()
        yield from _dealt(k, c, _shard_of(K.mix(k), n_pairs), n_pairs)

    def merge_pairs(table: pa.Table) -> pa.Table:
        i = table.column("shard")[0].as_py()
        k, c = _undealt(table)
        big = np.flatnonzero(c >= 255)
        _save(folder, f"pairs-{i}", k=k, c=np.minimum(c, 255).astype(np.uint8), at=big.astype(np.int64), big=c[big])
        # what this shard knows of its contexts and words
        ctx, word = (k >> U64(32)).astype(np.int64), (k & U64(0xFFFFFFFF)).astype(np.int64)
        number, at = np.unique(np.concatenate([ctx, word]), return_inverse=True)
        at_ctx, at_word = at[: len(k)], at[len(k):]
        stats = np.zeros((5, len(number)), dtype=np.int64)
        np.add.at(stats[0], at_ctx, c)
        for x in (1, 2, 3):
            stats[x] = np.bincount(at_ctx[c == x] if x < 3 else at_ctx[c >= 3], minlength=len(number))
        stats[4] = np.bincount(at_word, minlength=len(number))
        cut = np.searchsorted(number, np.arange(n_words + 1) * step)
        some = [s for s in range(n_words) if cut[s + 1] > cut[s]]
        shard = [*some, -1]  # -1: how many pairs were seen once, twice, three and four times
        nums = [planes(np.diff(number[cut[s]:cut[s + 1]], prepend=0)) for s in some] + [b""]
        vals = [b"".join(planes(np.ascontiguousarray(x[cut[s]:cut[s + 1]])) for x in stats) for s in some]
        vals.append(np.array([(c == x).sum() for x in (1, 2, 3, 4)], dtype=np.int64).tobytes())
        return pa.table({"w": pa.array(shard, pa.int32()), "k": pa.array(nums, pa.binary()), "s": pa.array(vals, pa.binary())})

    def merge_stats(table: pa.Table) -> pa.Table:
        w = table.column("w")[0].as_py()
        keys, vals = table.column("k").to_pylist(), table.column("s").to_pylist()
        if w < 0:
            out = np.sum([np.frombuffer(v, dtype=np.int64) for v in vals], axis=0)
            return pa.table({"w": pa.array([w], pa.int32()), "v": pa.array([[*out.tolist(), 0, 0, 0]], pa.list_(pa.int64()))})
        total = np.zeros((min(step, int(first[-1]) + 1 - w * step), 5), dtype=np.int64)
        for k, v in zip(keys, vals):
            num = np.cumsum(unplanes(k, np.int64)) - w * step
            n = len(v) // 5
            for x in range(5):
                total[num, x] += unplanes(v[x * n:(x + 1) * n], np.int64)
        _save(folder, f"words-{w}", s=total)
        f = total[:, 4]
        of = [int((f == x).sum()) for x in (1, 2, 3, 4)]
        return pa.table({"w": pa.array([w], pa.int32()), "v": pa.array([[*of, int((f >= 3).sum()), int(f.sum()), 0]], pa.list_(pa.int64()))})

    pairs = texts.mapInArrow(count_pairs, "shard int, k binary, c binary").groupBy("shard").applyInArrow(merge_pairs, "w int, k binary, s binary")
    seen, follow = np.zeros(7, dtype=np.int64), np.zeros(7, dtype=np.int64)
    for r in pairs.groupBy("w").applyInArrow(merge_stats, "w int, v array<long>").collect():  # one row a shard
        if r["w"] < 0:
            seen += np.array(r["v"])
        else:
            follow += np.array(r["v"])
    return Model(folder, first, n_tokens, n_pairs, step, n_words, discounts(*seen[:4].tolist()), discounts(*follow[:4].tolist()),
                 (int(follow[0]), int(follow[1]), int(follow[4])), int(follow[5]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, base_score, score)`` for every row: log10 probabilities of its words and the end.

    Null and empty texts have one token, the end.  Perplexity is ``10 ** (-score / n_tokens)``.  Repeated rows and null
    ids stay as they are; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def slice_scores(t: Tables, data: np.ndarray, off: np.ndarray):
        num, count, of, ptr, ctx = _numbered(t, data, off)
        words_stats = t.word_stats(num)
        # pairs of the slice by their position among its words (start of text: one more; unknown words differ)
        c_at = np.empty(len(of), dtype=np.int64)
        c_at[1:] = of[:-1]
        c_at[ptr[:-1]] = len(num)
        local, pair_of = np.unique(c_at * (len(num) + 1) + of, return_inverse=True)
        c_local, w_local = local // (len(num) + 1), local % (len(num) + 1)
        ctx_num = np.append(num, t.size)[c_local]
        known = np.flatnonzero((ctx_num >= 0) & (num[w_local] >= 0))
        keys = ctx_num[known].astype(U64) << U64(32) | num[w_local[known]].astype(U64)
        c = np.zeros(len(local), dtype=np.int64)
        order = np.argsort(keys)
        c[known[order]] = t.pair_counts(keys[order])
        start = t.word_stats(np.array([t.size]))
        ctx_stats = np.concatenate([words_stats, start])[c_local]
        logs = np.log10(model.p_pair(c, ctx_stats, words_stats[w_local, 4]))
        base = np.log10((count + 1) / (model.n_tokens + model.n_types + 1))
        at = ptr[:-1]
        return np.diff(ptr), np.add.reduceat((count[of] > 0).astype(np.int64), at), np.add.reduceat(base[of], at), np.add.reduceat(logs[pair_of], at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _open(model.spec)
        for b in batches:
            data, off = K.string_buffers(b.column(1))
            for i, j in K.slices(off):
                cols = slice_scores(t, data[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c) for c in cols)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")


def op5_kneser_ney_lm(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document's log10 probability by the model and by add-one unigrams (a null doc_id is learned from)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    model = train(docs.filter(~held))
    return score(docs, model).withColumnRenamed("id", "doc_id").select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
