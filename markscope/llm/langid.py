"""Language identification by interpolated Kneser-Ney character models.

Each language has one model of order ``ORDER`` over its letters (lower case; anything else is one separator): for every order
the n-grams seen, as sorted 64-bit hashes with their interpolated probabilities, and the contexts, as sorted hashes
with their back-off weights.  A text gets the language with the lowest cross-entropy per symbol.

Learning takes at most about ``LEARN_DOCS`` whole texts of each language (a documented bound, chosen by a hash of the id); Spark counts
their n-grams and builds one model per language from all of them.  To calibrate, a fifth of these texts is set aside from languages with
``ASIDE_FROM`` or more, and scored by models of the others: a text whose cross-entropy is above what ``QUANTILE`` of them reach, plus
``SLACK`` bits, is marked as rejected (a rarer language takes the limit of all set-aside texts together).  The models (bounded like the
sample) are broadcast; predicting is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm import textkit as K
from markscope.llm.common import crc_mod, ship
from markscope.llm.kneser_ney import discount_of, discounts

U64 = np.uint64
ORDER = 4
LEARN_DOCS = 1500
QUANTILE, SLACK = 0.999, 0.5
ASIDE_FROM = 20
#: Symbols of evidence that the score's posterior counts at most: neighbouring symbols are not independent.
EVIDENCE = 40
SEPARATOR = 0x20
_STEP = U64(K._mix_int(91) | 1)

# code point -> lower-case letter or separator; filled as code points turn up
_FOLD = np.zeros(0x110000, dtype=np.uint32)


def _fold(cps: np.ndarray) -> np.ndarray:
    seen = np.zeros(0x110000, dtype=bool)
    seen[cps] = True
    new = np.flatnonzero(seen & (_FOLD == 0))
    for c in new.tolist():
        ch = chr(c)
        low = ch.lower()
        _FOLD[c] = (ord(low) if len(low) == 1 and low.isalpha() else c) if ch.isalpha() else SEPARATOR
    return _FOLD[cps]


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(stream, row, n)``: symbols with ``ORDER - 1`` separators before each row, the row of each position (-1 for
    those separators), and each row's number of symbols (0 if it has no letter)."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[off]
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    s = _fold(cps)
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    letter = s != SEPARATOR
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])  # one separator after each word
    s, row = s[keep], row[keep]
    n = np.bincount(row, minlength=len(off) - 1)
    pos = np.arange(len(s)) + (row + 1) * (ORDER - 1)
    stream = np.full(len(s) + len(n) * (ORDER - 1), SEPARATOR, dtype=np.uint32)
    stream[pos] = s
    owner = np.full(len(stream), -1, dtype=np.int64)
    owner[pos] = row
    return stream, owner, n


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of each n-gram, given its symbols column by column."""
    h = np.full(len(columns[0]) if columns else 0, U64(len(columns)), dtype=U64)
    for c in columns:
        h = K.mix(h * _STEP + c.astype(U64))
    return h


def _grams(stream: np.ndarray, owner: np.ndarray):
    """The distinct n-grams of highest order: their last position, and for each symbol the number of its n-gram."""
    last = np.flatnonzero(owner >= 0)
    h = key_of([stream[last - k] for k in range(ORDER - 1, -1, -1)])
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    return last, last[first], of


def build(grams: np.ndarray, count: np.ndarray) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """A language's tables ``(order, 'p' or 'g', sorted hashes, values)`` from its distinct n-grams and their counts."""
    # lower orders count distinct left neighbours
    types = {ORDER: (grams, count)}
    for k in range(ORDER - 1, 0, -1):
        longer = types[k + 1][0]
        tail = longer[:, 1:]
        _, first, of = np.unique(key_of(list(tail.T)), return_index=True, return_inverse=True)
        types[k] = (tail[first], np.bincount(of))
    out, lower_keys, lower_p, unseen = [], None, None, 0.0
    for k in range(1, ORDER + 1):
        g, c = types[k]
        d = discounts(*(float((c == x).sum()) for x in (1, 2, 3, 4)))
        ctx = key_of(list(g[:, :-1].T)) if k > 1 else np.zeros(len(g), dtype=U64)
        ctx_keys, of = np.unique(ctx, return_inverse=True)
        total = np.bincount(of, weights=c)
        gamma = np.bincount(of, weights=discount_of(c, d)) / total
        if k == 1:
            lower = np.full(len(g), 1.0 / (len(g) + 1))
            unseen = gamma[0] / (len(g) + 1)
        else:
            lower = lower_p[np.searchsorted(lower_keys, key_of(list(g[:, 1:].T)))]
        p = (c - discount_of(c, d)) / total[of] + gamma[of] * lower
        keys = key_of(list(g.T))
        order = np.argsort(keys)
        lower_keys, lower_p = keys[order], p[order]
        out += [(k, "p", lower_keys, lower_p), (k, "g", ctx_keys, gamma)]
    out.append((0, "p", np.zeros(1, dtype=U64), np.array([unseen])))
    return out


class Models:
    """All languages' tables, and the cross-entropy above which each one rejects."""

    def __init__(self, tables: dict[str, dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]]):
        self.langs = sorted(tables)
        self.tables = tables
        self.limit = {x: np.inf for x in self.langs}

    @staticmethod
    def _find(table, keys):
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at]

    def log2(self, lang: str, columns: list[np.ndarray]) -> np.ndarray:
        """log2 probability of each n-gram's last symbol."""
        t = self.tables[lang]
        p = np.full(len(columns[0]), t[0, "p"][1][0])
        for k in range(1, ORDER + 1):
            if k > 1:
                seen, g = self._find(t[k, "g"], key_of(columns[ORDER - k:ORDER - 1]))
                p = np.where(seen, g, 1.0) * p
            seen, q = self._find(t[k, "p"], key_of(columns[ORDER - k:]))
            p = np.where(seen, q, p)
        return np.log2(p)

    def entropies(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rows x languages)`` cross-entropies in bits per symbol, and the numbers of symbols."""
        stream, owner, n = symbols(data, off)
        h = np.zeros((len(n), len(self.langs)))
        if len(stream) and (owner >= 0).any():
            last, ends, of = _grams(stream, owner)
            columns = [stream[ends - k] for k in range(ORDER - 1, -1, -1)]
            for j, lang in enumerate(self.langs):
                h[:, j] = -np.bincount(owner[last], weights=self.log2(lang, columns)[of], minlength=len(n))
        return h / np.maximum(n, 1)[:, None], n

    def predict(self, data: np.ndarray, off: np.ndarray):
        """Language (``und`` without letters or models), score, cross-entropy and rejection of each row."""
        h, n = self.entropies(data, off)
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), dtype=bool)
        best = np.argmin(h, axis=1)
        low = h[np.arange(len(n)), best]
        weight = np.log(2.0) * np.minimum(n, EVIDENCE)
        score = 1.0 / np.exp(-weight[:, None] * (h - low[:, None])).sum(axis=1)
        none = n == 0
        lang = ["und" if e else self.langs[b] for b, e in zip(best.tolist(), none.tolist())]
        limit = np.array([self.limit[x] for x in self.langs])
        return lang, np.where(none, 0.0, score), np.where(none, 0.0, low), none | (low > limit[best])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          learn_docs: int = LEARN_DOCS, fold=lambda k: crc_mod(k, 4) != 2) -> Models:
    """Models from at most about ``learn_docs`` texts a language, of the folds for which ``fold(id)`` holds.

    Rows with a null id, text or language teach nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("t").isNotNull() & fold(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return Models({})
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, learn_docs / n) * 1_000_000))))
    rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1_000_000)) < F.element_at(share, F.col("lang")))
    enough = [x for x, n in sizes.items() if min(n, learn_docs) >= ASIDE_FROM]
    aside = F.col("lang").isin(enough) & (F.pmod(F.xxhash64("id", F.lit(66)), F.lit(5)) == 0)
    names = [f"c{k}" for k in range(ORDER)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
            for x in sorted(set(pairs)):
                data, off = K.string_buffers(b.column(1).filter(pa.array([p == x for p in pairs])))
                for i, j in K.slices(off):
                    stream, owner, _ = symbols(data[off[i]:off[j]], off[i:j + 1] - off[i])
                    _, ends, of = _grams(stream, owner)
                    cols = [pa.array(stream[ends - k].astype(np.int32)) for k in range(ORDER - 1, -1, -1)]
                    n = np.bincount(of, minlength=len(ends))
                    yield pa.RecordBatch.from_arrays([pa.array([x[0]] * len(ends), pa.string()), *cols, pa.array(n), pa.array(n * (not x[1]))], ["lang", *names, "n", "n_rest"])

    def model(table: pa.Table) -> pa.Table:
        cols = np.stack([table.column(c).to_numpy().astype(np.uint32) for c in names], axis=1)
        order = np.lexsort(cols.T)
        out, lang = [], table.column("lang")[0].as_py()
        for full, n in ((True, "n"), (False, "n_rest")):
            count = table.column(n).to_numpy()[order]
            some = count > 0
            if some.any():
                out += [(full, *part) for part in build(cols[order][some], count[some])]
        return pa.table({"lang": [lang] * len(out), "whole": [p[0] for p in out], "k": pa.array([p[1] for p in out], pa.int32()), "kind": [p[2] for p in out],
                         "keys": pa.array([p[3].tobytes() for p in out], pa.binary()), "vals": pa.array([p[4].astype(np.float64).tobytes() for p in out], pa.binary())})

    grams = rows.select("lang", "t", aside.alias("aside")).mapInArrow(count, "lang string, " + ", ".join(f"{c} int" for c in names) + ", n long, n_rest long")
    tables = (grams.groupBy("lang", *names).agg(F.sum("n").alias("n"), F.sum("n_rest").alias("n_rest")).groupBy("lang")
              .applyInArrow(model, "lang string, whole boolean, k int, kind string, keys binary, vals binary"))
    got: dict = {True: {}, False: {}}
    for r in tables.collect():  # bounded by learn_docs texts a language
        got[r["whole"]].setdefault(r["lang"], {})[r["k"], r["kind"]] = (np.frombuffer(r["keys"], dtype=U64), np.frombuffer(r["vals"], dtype=np.float64))
    models = Models(got[True])
    held = predict(rows.filter(aside), Models(got[False]), "id", "t", extra=["lang"]).filter(F.col("lang_pred") == F.col("lang"))
    limits = held.groupBy("lang").agg(F.percentile("entropy", QUANTILE).alias("q")).collect()
    pooled = held.agg(F.percentile("entropy", QUANTILE)).first()[0]
    for lang in models.langs:
        models.limit[lang] = np.inf if pooled is None else pooled + SLACK
    for r in limits:
        models.limit[r["lang"]] = r["q"] + SLACK
    return models


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """``(id, lang_pred, score, entropy, rejected)`` and ``extra`` columns for every row.

    A text that is null or has no letter is ``und`` with score 0 and counts as rejected; so is every text if no language was
    learned.  Equal entropies: the first language by name.  Repeated rows and null ids stay as they are.
    """
    spark = docs.sparkSession
    ship(spark)
    extra = extra or []
    shared = spark.sparkContext.broadcast(models)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *(F.col(x) for x in extra))
    kind = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off = K.string_buffers(b.column(1))
            for i, j in K.slices(off, 2 << 20):
                lang, score, h, out = m.predict(data[off[i]:off[j]], off[i:j + 1] - off[i])
                cols = [b.column(k).slice(i, j - i) for k in (0, *range(2, 2 + len(extra)))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score), pa.array(h), pa.array(out)],
                                                 ["id", *extra, "lang_pred", "score", "entropy", "rejected"])

    return src.mapInArrow(run, f"id {kind['id']}, " + "".join(f"`{x}` {kind[x]}, " for x in extra) + "lang_pred string, score double, entropy double, rejected boolean")


def op6_langid_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document's language, score, cross-entropy and rejection."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learn(docs))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 4) == 2, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "entropy", "rejected")
