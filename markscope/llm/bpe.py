"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

The merges are compiled on demand.  In byte-level BPE a sequence of tokens is the encoding of its bytes exactly
when each pair of neighbours is (encoding the two tokens' bytes gives the two tokens back).  Hence every prefix
of a piece has one last token, and a left-to-right machine can follow it.  A state holds, for each position from which some
vocabulary entry may still end ahead, the trie node reached from there and the token that ends there; nothing else, so
few states serve all texts.  The arc for a byte gives the next state and the last token of the prefix that ends with it.
Last tokens name the whole encoding from the end backwards; what all ways of a state share is decided and emitted, and as no entry is
longer than the longest token, that lookahead is bounded.  States and arcs are made the first time a text needs them.

Whether two tokens are neighbours is read off the vocabulary's merge trees (``merge_trees``, made once on the driver):
undoing the later of the two tokens' merges step by step gives all pairs that met at the border while they were built; they stay
apart if no such pair would have merged before.

Decoding joins token bytes piecewise and runs an incremental UTF-8 state machine over the ends of
the pieces, so a character that is split between tokens comes out whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm.common import ship

MAX_STATES = 150_000
MAX_PIECES = 200_000
TOKEN_BITS = 21
DECIDE = 4096
SEGMENT = 1 << 19

# Unicode White_Space, which the pattern's \s stands for.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merge(ranks: dict[bytes, int], data: bytes, stop: int = 1) -> list[bytes]:
    """The merges applied to a few bytes, the lowest rank first, the leftmost of equal ones, down to ``stop`` parts."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > stop:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merge_trees(ranks: dict[bytes, int]) -> tuple[dict[int, int], dict[int, int]]:
    """Each token's left and right part in its last merge (-1 for a byte); tokens that no merges make are left out."""
    left, right = {}, {}
    for tok, r in ranks.items():
        if len(tok) == 1:
            left[r] = right[r] = -1
            continue
        parts = merge(ranks, tok, 2)
        if len(parts) == 2:
            left[r], right[r] = ranks[parts[0]], ranks[parts[1]]
    return left, right


class Transducer:
    """Encodes one piece at a time; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], trees=None, max_states: int = MAX_STATES):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size_of = {v: len(k) for k, v in ranks.items()}
        self.left, self.right = trees or merge_trees(ranks)
        self.max_states = max_states
        self.child: dict[int, int] = {}
        self.token_at, self.depth, self.inner = [-1], [0], [False]
        for tok, r in ranks.items():
            node = 0
            for b in tok:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            if r in self.left:
                self.token_at[node] = r
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1),)
        self.states = [start]
        self.number = {start: 0}
        self.step: dict[int, int] = {}

    def _stay_apart(self, a: int, b: int) -> bool:
        key = a << TOKEN_BITS | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= 4 * self.max_states:
                self.pairs.clear()
            got = self.pairs[key] = self._neighbours(a, b)
        return got

    def _neighbours(self, a: int, b: int) -> bool:
        ranks, text = self.ranks, self.bytes_of
        before = 1 << 62
        while True:
            met = ranks.get(text[a] + text[b])
            if met is not None and met < before:
                return False
            undo_a, undo_b = self.right[a], self.left[b]
            if undo_a >= 0 and (a > b or undo_b < 0):
                before, a = a, undo_a
            elif undo_b >= 0:
                before, b = b + 1, undo_b       # of equal ranks the leftmost pair merges first
            else:
                return True

    def _determinise(self, state: int, byte: int) -> int:
        alive, reached = [], -1
        for node, last in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            if self.inner[nxt]:
                alive.append((nxt, last))
            t = self.token_at[nxt]
            if reached < 0 and t >= 0 and (last < 0 or self._stay_apart(last, t)):
                reached = t
        if reached < 0:
            raise ValueError(f"no token for byte {byte}")
        alive.append((0, reached))
        key = tuple(alive)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        arc = self.step[state << 8 | byte] = number << TOKEN_BITS | reached
        return arc

    def _back(self, last: list[int], end: int) -> list[int]:
        """The encoding of the bytes up to ``end``: its last token, then that of what is before it."""
        out, size = [], self.size_of
        while end > 0:
            t = last[end - 1]
            out.append(t)
            end -= size[t]
        out.reverse()
        return out

    def _decided(self, state: int, last: list[int]) -> int:
        """The border up to which all ways of a state agree."""
        ends = {len(last) - self.depth[node] for node, _ in self.states[state]}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - self.size_of[last[far - 1]])
        return ends.pop()

    def run(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        direct = self.ranks.get(piece)
        if direct is not None:
            return [direct]
        if len(self.states) > self.max_states:
            self._reset()
        out: list[int] = []
        last: list[int] = []
        state, step, mask = 0, self.step, (1 << TOKEN_BITS) - 1
        for byte in piece:
            arc = step.get(state << 8 | byte)
            if arc is None:
                arc = self._determinise(state, byte)
            state = arc >> TOKEN_BITS
            last.append(arc & mask)
            if len(last) >= DECIDE:
                end = self._decided(state, last)
                out += self._back(last, end)
                del last[:end]
        return out + self._back(last, len(last)) if out else self._back(last, len(last))


class _Pieces(dict):
    """Piece to its ids as little-endian bytes: the pieces of late, and those before them that are in use again."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            got = self.machine.run(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(got)}I", *got)
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES // 2:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, trees=None):
        self.machine = Transducer(ranks, trees)
        exact = pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.pattern = regex.compile(exact)
        self.cut = regex.compile(f"(?<=[^{WHITE}])[{WHITE}]")
        self.pieces = _Pieces(self.machine)
        self.token_bytes = self.machine.bytes_of

    def segments(self, text: str, size: int = SEGMENT) -> Iterator[str]:
        """Parts that the pattern splits as it splits the whole: each ends before white space after other text."""
        at = 0
        while len(text) - at > size:
            m = self.cut.search(text, at + size)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode_bytes(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, segment by segment."""
        get = self.pieces.__getitem__
        for part in self.segments(text):
            yield b"".join(map(get, self.pattern.findall(part)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_bytes(text)), dtype="<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any cut, gives characters as soon as they are whole.

    The machine's state is the unfinished character at the end (a valid lead byte and its
    continuations so far); malformed bytes become U+FFFD as in a decode of the whole.
    """

    def __init__(self):
        self.rest = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of a valid but unfinished character at the end of data."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        n = self._unfinished(data)
        self.rest = data[len(data) - n:]
        return data[: len(data) - n].decode("utf-8", errors="replace")

    def end(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", errors="replace")


_CODECS: dict[str, Codec] = {}


def _codec(key: str, shared, pattern: str) -> Codec:
    """The worker's codec; its states and pieces serve all the tasks that the worker runs."""
    if key not in _CODECS:
        _CODECS.clear()
        ranks, trees = shared.value
        _CODECS[key] = Codec(ranks, pattern, trees)
    return _CODECS[key]


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False, chunk: int = 1 << 16) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256, n_decoded_chars)`` and ``ids`` if asked, for every row.

    Null counts as empty: no tokens, the hashes of nothing.  Special tokens' strings are ordinary text.  Rows
    with equal or null ids stay as they are; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    table = load_ranks(rank_file)
    key = hashlib.sha256(repr((sorted(table.items()), pattern)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((table, merge_trees(table)))  # a vocabulary: bounded by its file
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, sha, back, chars, lists = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    h, d, m, c, utf8, all_ids = hashlib.sha256(), hashlib.sha256(), 0, 0, Utf8Stream(), []
                    for ids in codec.encode_bytes(text or ""):
                        h.update(ids)
                        ids = np.frombuffer(ids, dtype="<u4")
                        m += len(ids)
                        for k in range(0, len(ids), chunk):
                            raw = codec.decode_bytes(ids[k:k + chunk].tolist())
                            d.update(raw)
                            c += len(utf8.feed(raw))
                        if with_ids:
                            all_ids.append(ids)
                    c += len(utf8.end())
                    n.append(m)
                    sha.append(h.hexdigest())
                    back.append(d.hexdigest())
                    chars.append(c)
                    if with_ids:
                        lists.append(np.concatenate(all_ids).astype(np.int32) if all_ids else np.zeros(0, np.int32))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(chars, pa.int64())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_decoded_chars"]
                if with_ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_decoded_chars long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, schema + (", ids array<int>" if with_ids else ""))


def op7_byte_bpe_transducer(spark, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    """Registered query: token count and digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_decode(docs, rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")
