"""SimHash near-duplicates found with pivot distance tables.

1. ``fingerprints``: 64-bit SimHash of each text's 3-word shingles (XXH64, seed 42), in Arrow batches.
2. Equal fingerprints become one row (their smallest id): a large group of copies costs one row.
3. ``pivot_cells``: the table of Hamming distances to reference fingerprints deals rows out.  At each
   level one pivot splits a cell at the median distance ``t``: rows at ``d <= t`` go left, rows at
   ``d > t - r`` go right.  Two rows within ``r`` bits differ by at most ``r`` in every coordinate, so
   they always meet in some cell; pairs that differ more in some coordinate are discarded unseen.
   Cells that stay large get further pivots; a cell that no pivot splits is dealt out in block pairs.
4. In a cell, rows are sorted by one more coordinate; only rows within ``r`` of each other in it are
   paired, the next coordinates discard pairs one after the other, and the survivors are verified
   by XOR and bit count.
5. Links leave a task as a star per local group, never as all pairs; components join the stars.

The table's row is 16 bytes, each level adds about a fifth of the rows and halves the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm import textkit as K
from markscope.llm.common import hot_join, shared_path, ship, shuffle_partitions, written
from markscope.llm.components import connected_components

U64 = np.uint64
#: The reference fingerprints, from a rule so that every task has the same.
PIVOTS = np.array([K._mix_int(5000 + i) for i in range(192)], dtype=U64)
CELL_LEVELS = 160  # the rest are coordinates inside cells
CELL_ROWS = 400
LARGE_CELL = 6000


def _majority(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of each row's hashes; rows without hashes give 0."""
    out = np.zeros(len(first), dtype=U64)
    rows = np.flatnonzero(count)
    if len(rows) == 0:
        return out
    n, at = count[rows], first[rows]
    pieces = -(-n // 255)  # a byte lane holds counts up to 255
    seg_first = np.cumsum(pieces) - pieces
    seg_no = np.arange(int(pieces.sum())) - np.repeat(seg_first, pieces)
    seg_start = np.repeat(at, pieces) + 255 * seg_no
    ones = U64(0x0101010101010101)
    bits = np.zeros((len(rows), 64), dtype=np.int64)
    for j in range(8):
        lanes = np.add.reduceat((h >> U64(j)) & ones, seg_start)
        per_seg = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, j::8] = np.add.reduceat(per_seg, seg_first, axis=0)
    over = (2 * bits > n[:, None]).astype(np.uint8)
    out[rows] = np.packbits(over, axis=1, bitorder="little").view(U64).ravel()
    return out


def simhash(data: np.ndarray, off: np.ndarray, width: int = 3) -> np.ndarray:
    """Fingerprints of the rows of one slice."""
    starts, ends, ptr = K.word_bounds(data, off, K.SPACE_WORD)
    n_words = np.diff(ptr)
    # the words of the slice in lower case, each followed by one space
    lengths = ends - starts + 1
    src = K.take_ranges(starts, lengths)
    norm = K.LOWER[data[np.minimum(src, max(len(data) - 1, 0))]] if len(data) else data
    stop = np.cumsum(lengths)
    begin = stop - lengths
    norm[stop - 1] = 0x20
    buf = norm.tobytes()
    n_sh = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    lead = K.take_ranges(ptr[:-1], n_sh)
    reach = np.minimum(width, np.repeat(n_words, n_sh)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(buf[i:j], 42) for i, j in
                     zip(begin[lead].tolist(), (stop[lead + reach] - 1).tolist())), dtype=U64, count=len(lead))
    return _majority(h, np.cumsum(n_sh) - n_sh, n_sh)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, fp)`` and ``extra`` columns for every row; null text counts as empty, a text without words has fingerprint 0."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *extra)
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = K.string_buffers(b.column(1))
            for i, j in K.slices(off):
                fp = simhash(data[off[i]:off[j]], off[i:j + 1] - off[i], width)
                kept = [b.column(k).slice(i, j - i) for k in (0, *range(2, 2 + len(extra)))]
                yield pa.RecordBatch.from_arrays([kept[0], pa.array(fp.view(np.int64)), *kept[1:]], ["id", "fp", *extra])

    return src.mapInArrow(run, f"id {kinds['id']}, fp long" + "".join(f", {x} {kinds[x]}" for x in extra))


def _thresholds(classes: DataFrame, levels: list[int]) -> list[int]:
    """The median distance to each pivot, over all rows: one histogram row per distance at most."""
    ids = [int(PIVOTS[i].view(np.int64)) for i in levels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((len(ids), 65), dtype=np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(U64)
            for k, p in enumerate(ids):
                hist[k] += np.bincount(np.bitwise_count(fp ^ np.int64(p).view(U64)), minlength=65)
        k, d = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(hist[k, d])], ["k", "d", "n"])

    hist = np.zeros((len(ids), 65), dtype=np.int64)
    for k, d, n in (classes.select("fp").mapInArrow(run, "k int, d int, n long")
                    .groupBy("k", "d").agg(F.sum("n").alias("n")).collect()):  # 65 rows a pivot at most
        hist[k, d] = n
    cum = np.cumsum(hist, axis=1)
    return [int(np.searchsorted(c, max(1, c[-1]) / 2)) for c in cum]


def _split(rows: DataFrame, levels: list[int], cut: list[int], r: int) -> DataFrame:
    """Deal ``(fp, rep, cell)`` out over the cells of further levels."""
    pivots = [int(PIVOTS[i].view(np.int64)) for i in levels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                fp = part.column(0).to_numpy(zero_copy_only=False).view(U64)
                rep = part.column(1).to_numpy(zero_copy_only=False)
                cell = part.column(2).to_numpy(zero_copy_only=False).view(U64)
                for p, t in zip(pivots, cut):
                    d = np.bitwise_count(fp ^ np.int64(p).view(U64)).astype(np.int16)
                    left, right = np.flatnonzero(d <= t), np.flatnonzero(d > t - r)
                    both = np.concatenate([left, right])
                    cell = K.mix(np.concatenate([cell[left] * U64(2), cell[right] * U64(2) + U64(1)]))
                    fp, rep = fp[both], rep[both]
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(rep), pa.array(cell.view(np.int64))], ["fp", "rep", "cell"])

    return rows.mapInArrow(run, "fp long, rep long, cell long")


def _cell_links(fp: np.ndarray, rep: np.ndarray, cell: np.ndarray, r: int, block: int = 1 << 19):
    """Pairs (positions) of rows of one cell within r bits, in blocks."""
    coords = [np.bitwise_count(fp ^ p).astype(np.int16) for p in PIVOTS[CELL_LEVELS:CELL_LEVELS + 6]]
    _, seg = np.unique(cell, return_inverse=True)
    key = seg.astype(np.int64) * 256 + coords[0]
    order = np.argsort(key, kind="stable")
    key, fp, rep = key[order], fp[order], rep[order]
    coords = [c[order] for c in coords]
    # within a cell, the rows after i whose first coordinate is at most r larger
    last = np.searchsorted(key, key + r, side="right")
    n_after = last - np.arange(len(key)) - 1
    done = np.cumsum(n_after)
    a = 0
    while a < len(key):
        base = done[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(done, base + block, side="right")))
        i = np.repeat(np.arange(a, b), n_after[a:b])
        j = K.take_ranges(np.arange(a + 1, b + 1), n_after[a:b])
        for c in coords[1:]:
            keep = np.abs(c[i] - c[j]) <= r
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= r
        yield rep[i[keep]], rep[j[keep]]
        a = b


def _stars(pairs) -> tuple[np.ndarray, np.ndarray]:
    """One star (smallest member, member) for each connected group of the pairs."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in pairs:
        u, v = np.concatenate([u, a]), np.concatenate([v, b])
        if len(u) > 1 << 20:  # fold, so that a dense cell never holds all its pairs
            u, v = _fold(u, v)
    return _fold(u, v)


def _fold(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(u) == 0:
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def _links(cells: DataFrame, r: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not got:
            return
        fp, rep, cell = (np.concatenate([g[k] for g in got]) for k in range(3))
        u, v = _stars(_cell_links(fp.view(U64), rep, cell, r))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return cells.mapInArrow(run, "u long, v long")


def pivot_links(classes: DataFrame, r: int = 2, cell_rows: int = CELL_ROWS, large: int = LARGE_CELL) -> DataFrame:
    """Stars ``(u, v)`` of the ``rep`` whose fingerprints ``classes(fp, rep)`` are within ``r`` bits.

    ``classes`` holds each fingerprint once, with a long of its own.
    """
    spark = classes.sparkSession
    n = classes.count()
    depth = int(np.clip(np.ceil(np.log(max(n, 2) / cell_rows) / np.log(1 / 0.62)), 0, 60))
    rows = classes.select("fp", "rep", F.lit(1).cast("long").alias("cell"))
    tasks = max(shuffle_partitions(spark), int(n * 1.24 ** depth // 400_000) + 1)
    level, links = 0, None
    while True:
        levels = list(range(level, min(level + depth, CELL_LEVELS)))
        if levels:
            rows = written(_split(rows, levels, _thresholds(rows, levels), r), "simhash-cells")
            level += len(levels)
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > large)
        big = written(sizes.withColumnRenamed("cell", "c"), "simhash-large")
        if big.isEmpty():
            part = _links(rows.repartition(tasks, "cell"), r)
            return part if links is None else links.union(part)
        small = rows.join(big, F.col("cell") == F.col("c"), "left_anti")
        part = written(_links(small.repartition(tasks, "cell"), r), "simhash-links")
        links = part if links is None else links.union(part)
        rest = rows.join(big, F.col("cell") == F.col("c"))
        if level >= CELL_LEVELS:
            # no pivot parts these rows: deal them out in block pairs
            k = F.ceil(F.col("size") / large).cast("int")
            own = F.pmod(F.xxhash64("fp"), k).cast("int")
            dealt = (rest.withColumn("k", k).withColumn("own", own)
                     .withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
                     .select("fp", "rep", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell")))
            return links.union(_links(dealt.repartition(tasks, "cell"), r))
        rows = rest.select("fp", "rep", "cell")
        depth = 8


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    max_bits: int = 2, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, fp, component, group)`` and ``extra`` columns for every row of ``docs``; group: the component's smallest fingerprint.

    component: the smallest id reachable over links of at most ``max_bits`` differing bits, itself
    included.  Ids are whole numbers.  Null text is empty; texts without words share fingerprint 0
    and are linked like any others; rows with equal ids or texts stay separate rows; a row with a
    null id has its group's smallest id (null if the whole group has none); groups don't meet over equal ids.  Extra columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, width, extra), "simhash-fp")
    classes = written(fps.groupBy("fp").agg(F.min("id").cast("long").alias("rep")), "simhash-classes")
    # nodes are the fingerprints themselves: ids may repeat or be null
    links = pivot_links(classes.select("fp", F.col("fp").alias("rep")), max_bits)
    comp = connected_components(links, "simhash-components")
    linked = written(classes.join(comp, F.col("fp") == F.col("node")).select(F.col("fp").alias("lf"), F.col("component").alias("root"), "rep"), "simhash-linked")
    smallest = written(linked.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("low")), "simhash-lowest")
    # a component may hold any part of the fingerprints, a fingerprint any part of the rows
    lows = hot_join(linked.drop("rep"), smallest, "root", "r", "simhash-hot-roots")
    named = written(classes.join(lows, F.col("fp") == F.col("lf"), "left")
                    .select(F.col("fp").alias("f"), F.when(F.col("lf").isNull(), F.col("rep")).otherwise(F.col("low")).alias("component"),
                            F.coalesce("root", "fp").alias("group")), "simhash-named")
    return hot_join(fps, named, "fp", "f", "simhash-hot").select("id", "fp", "component", "group", *extra)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of each group the row with the smallest id.

    Exactly one row of a group stays, also if ids repeat; a null id stays only where its whole group has none.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "simhash-input")
    docs.write.parquet(path)
    copy = spark.read.schema(docs.schema).parquet(path)
    placed = copy.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    groups = written(near_duplicates(placed, "id", "t", width, max_bits, ("file", "row")), "simhash-groups")
    stays = (groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "file", "row")).alias("k"))
             .select(F.col("k.file").alias("__file"), F.col("k.row").alias("__row")))
    return copy.join(stays, (copy["_metadata.file_path"] == stays["__file"]) & (copy["_metadata.row_index"] == stays["__row"]), "left_semi")


def op4_simhash_pivot_dedup(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document's fingerprint and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, "doc_id", "text", width=3, max_bits=2)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))
