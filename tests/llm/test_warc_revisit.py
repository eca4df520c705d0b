"""WARC round trips, odd payloads, revisits."""
import gzip
import hashlib

from markscope.llm import warc_revisit as W

LONG = "<html>é" + "x" * 200
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" + "y" * 100 + "\r\n\r\n"
ROWS = [(5, "http://a/5", LONG), (2, "http://a/2", LONG), (9, None, LONG), (1, "http://a/1", "short"), (3, "http://x\r\nEvil: 1", "short"),
        (4, "u", None), (6, "u", ""), (7, "u", FAKE), (8, "u", FAKE), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "é" * 50), (13, "u", "é" * 50),
        (2, "again", LONG), (None, "null", LONG), (14, "u", "\r\n\r\n" * 60), (15, "u", "q" * 500_000), (16, "u", " \n"), (5, "http://a/5", LONG)]


def test_records(spark, tmp_path):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string").repartition(4)
    path = str(tmp_path / "w")
    W.write_archive(W.mark_revisits(df, "page_id", "url", "html"), path, archive_bytes=3000)
    got = W.resolve(W.read_archive(spark, path)).collect()
    want = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        low = min((j for j, _, g in ROWS if g == h and j is not None), default=None)
        again = len(raw) >= 100 and low is not None and i != low
        want.append((str(i) if i is not None else None, "revisit" if again else "response", hashlib.sha256(raw).hexdigest(), len(raw), str(low) if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_archive_passes_its_limit(spark, tmp_path):
    rows = [(k, "u", f"{k} " + "s" * 150) for k in range(60)] + [(100 + k, "u", f"{k} " + "L" * 40_000) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    W.write_archive(W.mark_revisits(df, "page_id", "url", "html"), path, archive_bytes=30_000, limit_bytes=60_000)
    sizes = [len(gzip.decompress(r["content"])) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(sizes) >= 5 and max(sizes) < 60_000 and sorted(sizes)[-3] > 40_000
    assert sorted(int(r["page_id"]) for r in W.resolve(W.read_archive(spark, path)).collect()) == [r[0] for r in rows]


def test_rewriting_archives(spark, tmp_path):
    df = spark.createDataFrame([r for r in ROWS if r[0] is not None][:13], "page_id long, url string, html string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    W.write_archive(W.mark_revisits(df, "page_id", "url", "html", min_bytes=1 << 60), a, "2000-01-01T00:00:00Z")
    raw = W.read_archive(spark, a, payloads=True).collect()
    assert {r["record_type"] for r in raw} == {"response"} and all(r["digest"] == r["header_digest"] for r in raw)
    W.deduplicate_archive(spark, a, b, date="2001-01-01T00:00:00Z")
    assert sorted(r["page_id"] for r in W.read_archive(spark, b).filter("record_type = 'revisit'").collect()) == ["13", "5", "8", "9"]
    assert all(p.endswith(".gz") for p in spark.read.format("binaryFile").load(b).select("path").toPandas()["path"])
    text = spark.read.text(b, wholetext=True).collect()
    assert all("2000-01-01" not in t["value"] for t in text)
    assert any("WARC-Refers-To-Target-URI: http://a/2" in t["value"] for t in text)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_archive(W.mark_revisits(df, "page_id", "url", "html"), str(tmp_path / "e"))
    assert W.resolve(W.read_archive(spark, str(tmp_path / "e"))).count() == 0
