"""The pipeline against a brute-force version of every stage after the classifier, and odd inputs."""
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from markscope.llm import bpe, quality
from markscope.llm import textkit as K
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    w, bias = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    import pyarrow as pa
    data, off = K.string_buffers(pa.array(list(rows.values())))
    kept = [i for i, s in zip(rows, quality.scores(data, off, w, bias)) if s >= 0.5]
    last = {}
    for i in sorted(kept):
        last[rows[i]] = i
    kept = sorted(last.values())
    comp = brute_components({i: brute_fp(rows[i]) for i in kept})
    kept = [i for i in kept if comp[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [i for i, _, hit, _ in brute_hits([(i, rows[i]) for i in kept], items) if not hit]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {i: (lib.encode_ordinary(rows[i]), hashlib.sha256(rows[i].encode()).hexdigest()) for i in kept}
    got = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(rows)


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (None, "a b c d", None), (None, "a b c d", "en"), (3, "a b c d", "en"), (3, "other words in here", None), (3, "other words in here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.columns == docs.columns, name
            texts = [r["text"] or "" for r in out.collect()]
            if name in ("exact", "near"):
                assert sorted(texts) == sorted({r["text"] or "" for r in d.collect()}), name
        assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() == d.count()
