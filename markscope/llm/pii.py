"""Personal data: base patterns, and bootstrapped contextual extraction beyond them.

The scan finds the base spans of each whole text and, outside them, candidates: number-like or address-like strings that no
base pattern takes.  Both come with the words around them.  Spark then scores a graph of lexical patterns (the words
before, the two words before, the words on both sides) and instances (normalised values): base
spans are the seeds; a pattern's confidence for a kind is the share of trusted instances of that kind among these
and what speaks against it, given enough of them: seeds of other kinds and values of no kind.  Values that may be of the kind but
are not trusted yet speak neither way, however many they are; an instance of the same kind is trusted if its patterns together (noisy or) make it likely.  Instances that become
trusted support patterns in the next round, until a round trusts nothing new (trust only grows, so the rounds end).  A candidate is
scored for every kind that its shape allows, and a place takes the kind with the highest score.  Trusted candidates become added spans; base spans stay as they are.

Context words are whole words; one of more than ``LONG_WORD`` characters counts as "~", whatever it is.

Only pattern-instance pairs are shuffled, folded to distinct ones first; a frequent pattern is summed
by partial aggregation, and the joins back to it can be split by AQE.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markscope.llm.common import ship, written

KINDS = ["email", "ip", "card", "phone"]
OTHER = len(KINDS)
#: No corpus should need as many; more raise an error.
MAX_ROUNDS = 100
MIN_SUPPORT = 3
PATTERN_AT_LEAST = 0.5
TRUST_AT_LEAST = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits, with three more parts if they follow; a run that does not go on is passed over whole.
_IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"@|\(at\)|\[at\]")
_HOST = re.compile(r"[A-Za-z0-9.()\[\]-]++")
_WEAK_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}+[0-9])*+")
LONG_WORD = 64
CONTEXT = 256       # characters looked at for two words


def emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` leftmost, non-overlapping, from one '@' to the next."""
    low = 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > low and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        low = m.end() if m else at + 1
        if m:
            yield s, low
        at = text.find("@", low)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if "." in m[0] and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _kinds_of(value: str) -> list[int]:
    """The kinds that a candidate's shape allows."""
    if not value[0].isdigit() and value[0] != "(" or "@" in value or "at" in value:
        return [0]
    digits = sum(c in "0123456789" for c in value)
    fits = [1] if re.fullmatch(r"[0-9]{1,4}(?:\.[0-9]{1,4}){3}", value) else []
    fits += [2] if 12 <= digits <= 19 else []
    fits += [3] if 7 <= digits <= 15 else []
    return fits or [OTHER]


def _normal(kind: int, value: str) -> str:
    return f"{kind}:" + (value.lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", value))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8"), digest_size=8).digest(), "little", signed=True)


def _word(w: str) -> str:
    return "~" if len(w) > LONG_WORD else w.lower().strip(".,;:!?\"'()[]|")


def _patterns(text: str, s: int, e: int) -> list[int]:
    low = max(0, s - CONTEXT)
    left = text[low:s].split()
    if low and left and not text[low].isspace() and not text[low - 1].isspace():
        left[0] = "~" * (LONG_WORD + 1)      # begins before what is looked at
    left = [_word(w) for w in left[-2:]]
    left = ["~" if low else "^"] * (2 - len(left)) + left
    after = text[e:e + CONTEXT]
    right = after.split(None, 1)
    first = _word(right[0]) if right else "~" if e + CONTEXT < len(text) else "$"
    return [_number(f"1 {left[1]}"), _number(f"2 {left[0]} {left[1]}"), _number(f"3 {left[1]} {first}")]


def weak_spans(text: str) -> list[tuple[int, int]]:
    """Candidates in order: address-like strings around an at sign or its spellings, and number-like ones that meet none of them."""
    out, low = [], 0
    for m in _AT.finditer(text):
        s = m.start()
        while s > low and text[s - 1] in _LOCAL:
            s -= 1
        host = _HOST.match(text, m.end()) if low <= s < m.start() else None
        low = max(low, host.end() if host else m.end())
        if host:
            out.append((s, low))
    numbers, i, taken = [], 0, len(out)
    for m in _WEAK_NUMBER.finditer(text):
        while i < taken and out[i][1] <= m.start():
            i += 1
        if i == taken or out[i][0] >= m.end():
            numbers.append(m.span())
    return sorted(out + numbers)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates (once for each kind they may be) with their patterns."""
    out = [{"s": s, "e": e, "kind": k, "seed": True, "v": _number(_normal(k, text[s:e])), "p": _patterns(text, s, e)} for s, k, e in base]
    if "@" not in text and "(at)" not in text and "[at]" not in text and not _DIGIT.search(text):
        return out
    i = 0
    for s, e in weak_spans(text):
        while i < len(base) and base[i][2] <= s and not any(b[2] > s for b in base[i:i + 4]):
            i += 1
        if any(b[0] < e and s < b[2] for b in base[max(0, i - 4):i + 8]):
            continue
        p = _patterns(text, s, e)
        out += [{"s": s, "e": e, "kind": k, "seed": False, "v": _number(_normal(k, text[s:e])), "p": p} for k in _kinds_of(text[s:e])]
    return out


def _spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SCAN = ("id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, "
         "mentions array<struct<s: int, e: int, kind: int, seed: boolean, v: long, p: array<long>>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's base spans, and the mentions from which patterns are induced."""
    ship(docs.sparkSession)
    mention = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.int32()), ("seed", pa.bool_()), ("v", pa.int64()), ("p", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, spell, sha, found = [[], [], [], []], [], [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    for k in range(4):
                        n[k].append(sum(x[1] == k for x in base))
                    spell.append(_spell(base))
                    sha.append(hashlib.sha256(spell[-1].encode()).hexdigest())
                    found.append(mentions(text or "", base))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(spell, pa.string()), pa.array(sha, pa.string()), pa.array(found, mention)],
                    ["id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "mentions"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, _SCAN.format(kind=kind))


def trusted_instances(found: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(v, kind, score)`` of the instances that are no seeds and come to be trusted, from ``(v, kind, seed, p)`` mentions."""
    edges = written(found.select("v", "kind", F.explode("p").alias("p")).distinct(), "pii-edges")
    seeds = written(found.groupBy("v", "kind").agg(F.max("seed").alias("seed")), "pii-instances")
    # what speaks against a pattern's kind: all known instances without that kind's seeds
    known = edges.join(seeds.filter(F.col("seed") | (F.col("kind") == OTHER)).select(F.col("v").alias("sv"), F.col("kind").alias("sk")), F.expr("v = sv and kind = sk"))
    against = written(known.groupBy("p").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(OTHER)))
                      .select(F.col("p").alias("wp"), F.array(*(F.col("n") - F.col(f"n{k}") for k in range(OTHER))).alias("against")), "pii-known")
    trusted = seeds.filter("seed").select(F.col("v").alias("tv"), F.col("kind").alias("tk"), F.lit(1.0).alias("w"))
    count = 0
    for _ in range(max_rounds):
        sums = (edges.join(trusted, F.expr("v = tv and kind = tk")).groupBy("p", "kind").agg(F.sum("w").alias("f"))
                .filter(F.col("f") >= MIN_SUPPORT))
        patterns = written(sums.join(against, F.col("p") == F.col("wp"), "left")
                           .select(F.col("p").alias("pp"), F.col("kind").alias("pk"), (F.col("f") / (F.col("f") + F.coalesce(F.get("against", F.col("kind")), F.lit(0)))).alias("conf"))
                           .filter(F.col("conf") >= PATTERN_AT_LEAST), "pii-patterns")
        # 1 - product of (1 - confidence); a confidence of one is held just below it
        likely = (edges.join(patterns, F.expr("p = pp and kind = pk")).groupBy("v", "kind")
                  .agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("w")).filter(F.col("w") >= TRUST_AT_LEAST))
        new = written(likely.join(seeds.filter("not seed").select(F.col("v").alias("sv"), F.col("kind").alias("sk")), F.expr("v = sv and kind = sk"))
                      .select("v", "kind", "w"), "pii-trusted")
        before, count = count, new.count()
        if count == before:
            break
        trusted = seeds.filter("seed").select(F.col("v").alias("tv"), F.col("kind").alias("tk"), F.lit(1.0).alias("w")).union(
            new.select(F.col("v").alias("tv"), F.col("kind").alias("tk"), "w"))
    else:
        raise RuntimeError(f"instances still become trusted after {max_rounds} rounds")
    return new.filter(F.col("kind") < OTHER).select("v", "kind", F.col("w").alias("score"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` for every row.

    The counts and base_sha256 are those of the base spans; spans spells all of them, added ones too, as kind:start:end in
    code points.  Null counts as empty: no spans.  Repeated rows and null ids stay as they are; other columns are ignored.
    """
    table = written(scan(docs, id_col, text_col), "pii-scan")
    rows = table.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    found = rows.select("file", "row", F.explode("mentions").alias("m")).select("file", "row", "m.*")
    trusted = trusted_instances(found, max_rounds).select(F.col("v").alias("tv"), F.col("kind").alias("tk"), "score")
    added = (found.filter("not seed").join(trusted, F.expr("v = tv and kind = tk"))
             .groupBy("file", "row", "s", "e").agg(F.max_by("kind", F.struct("score", (-F.col("kind")).alias("k"))).alias("kind"))
             .groupBy("file", "row").agg(F.collect_list(F.struct("s", "kind", "e")).alias("more"))
             .withColumnsRenamed({"file": "f", "row": "r"}))
    names = F.array(*(F.lit(k) for k in KINDS))
    every = F.array_sort(F.concat(
        F.transform(F.filter("mentions", lambda m: m["seed"]), lambda m: F.struct(m["s"].alias("s"), m["kind"].alias("kind"), m["e"].alias("e"))), F.col("more")))
    spelled = F.concat_ws(",", F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))))
    return rows.join(added, F.expr("file = f and row = r"), "left").select(
        "id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.when(F.col("more").isNull(), F.col("base")).otherwise(spelled).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_added"))


def op2_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    """Registered query: base and added spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return personal_data(docs).withColumnRenamed("id", "doc_id")
