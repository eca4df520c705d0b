"""BPE against the tiktoken library, and exact round trips."""
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from markscope.llm import bpe as B

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]
ALPHABET = ["the", "th", "ing", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "é", "ß", "日本", "🙂", "!!", "a", "b", "ab",
            "\x1c", "\x85", "\xa0", " ", "　", "​", "²", "Ⅷ", "٣", "%%%", "<|endoftext|>", "zq", "X", "\x00", "́"]


def texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        yield "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40)))
    for _ in range(n // 4):
        yield "".join(chr(rnd.choice([rnd.randrange(0x20, 0x7F), rnd.randrange(0x80, 0xD800), rnd.randrange(0xE000, 0x10FFFF)])) for _ in range(30))


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name):
    ranks = B.load_ranks(P.path(name))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = B.Codec(ranks, P.PATTERN)
    for t in [*texts(1, 1500), "", " ", "a" * 3000, "ab" * 700 + "é" * 300, "x y" * 1000, "=" * 999, "thethethe" * 50, " \n \n x"]:
        ids = codec.encode(t)
        assert ids == lib.encode_ordinary(t), repr(t)
        assert codec.decode_bytes(ids) == t.encode()


def test_all_tokens_and_small_cache():
    ranks = B.load_ranks(P.path(FILES[0]))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = B.Codec(ranks, P.PATTERN)
    codec.machine.max_states = 50
    toks = [t.decode(errors="ignore") for t in list(ranks)[::7]]
    text = "".join(toks)
    assert codec.encode(text) == lib.encode_ordinary(text)
    text = " ".join(a + b for a, b in zip(toks, toks[3:]))
    assert codec.encode(text) == lib.encode_ordinary(text)


def test_neighbours_are_those_of_the_merges():
    ranks = B.load_ranks(P.path(FILES[0]))
    machine = B.Transducer(ranks)
    rnd = random.Random(8)
    toks = [t for t in ranks if ranks[t] in machine.left]
    by_start: dict[bytes, list[bytes]] = {}
    for t in toks:
        by_start.setdefault(t[:1], []).append(t)
    n = 0
    for _ in range(4000):
        a = rnd.choice(toks)
        whole = rnd.choice(toks)
        k = rnd.randrange(1, len(whole) + 1)        # often a border inside another token
        b = rnd.choice(by_start[whole[k:k + 1]]) if k < len(whole) else rnd.choice(toks)
        a = whole[:k] if whole[:k] in ranks and ranks[whole[:k]] in machine.left else a
        want = B.merge(ranks, a + b) == [a, b]
        n += want
        assert machine._neighbours(ranks[a], ranks[b]) == want, (a, b)
    assert 400 < n < 3600


def test_long_pieces_are_emitted_before_their_end():
    ranks = B.load_ranks(P.path(FILES[0]))
    lib = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    machine = B.Transducer(ranks)
    for piece in ("=" * 20_000, "ab" * 9000, "".join(rnd.choice("thean ") for _ in range(30_000))):
        assert machine.run(piece.encode()) == lib.encode_ordinary(piece)


def test_pairs_and_pieces_outlive_the_states(monkeypatch):
    monkeypatch.setattr(B, "MAX_PIECES", 40)
    ranks = B.load_ranks(P.path(FILES[0]))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = B.Codec(ranks, P.PATTERN)
    codec.machine.max_states = 30
    for t in texts(5, 300):
        assert codec.encode(t) == lib.encode_ordinary(t)
    assert len(codec.machine.states) < 300 and len(codec.machine.pairs) > 60 and codec.pieces.before and len(codec.pieces) <= 20


def test_segments_do_not_change_ids():
    codec = B.Codec(B.load_ranks(P.path(FILES[0])), P.PATTERN)
    for t in [*texts(3, 200), "no-space" * 100]:
        parts = list(codec.segments(t, 5))
        assert "".join(parts) == t
        assert [x for p in parts for x in codec.pattern.findall(p)] == codec.pattern.findall(t)


def test_utf8_machine():
    rnd = random.Random(2)
    for _ in range(400):
        data = "".join(rnd.choice("aé日🙂") for _ in range(12)).encode()
        if rnd.random() < 0.5:
            data = bytes(b if rnd.random() < 0.8 else rnd.randrange(256) for b in data)
        s, out, i = B.Utf8Stream(), "", 0
        while i < len(data):
            k = rnd.randint(1, 4)
            out += s.feed(data[i:i + k])
            i += k
        assert out + s.end() == data.decode("utf-8", errors="replace")


def test_table(spark):
    rows = [(i, t, i) for i, t in enumerate([*texts(9, 60), "long " * 200_000])] + [(None, None, 1), (3, "", 1), (3, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(P.path(FILES[0])), special_tokens={})
    got = B.encode_decode(df, P.path(FILES[0]), P.PATTERN, with_ids=True).collect()

    def want(i, t):
        ids = lib.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                hashlib.sha256((t or "").encode()).hexdigest(), len(t or ""), ids)
    assert sorted(map(tuple, got), key=str) == sorted((want(i, t) for i, t, _ in rows), key=str)
    assert B.encode_decode(df.limit(0), P.path(FILES[0]), P.PATTERN).count() == 0
