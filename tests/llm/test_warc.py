import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from payscope.llm import warc as W
from tests.conftest import SF001


def pages(spark):
    big = "<p>%s</p>" % ("x" * 2000)
    rows = [(1, "u1", big), (2, "u2", big), (3, "u3", "é" * 600), (4, "u4", "é" * 600), (5, None, "small"), (6, "u6", "small"), (7, "u7", None), (8, "u8", ""),
            (9, "a\r\nWARC-Type: revisit", "line\r\n\r\nWARC/1.1\r\n"), (2, "u2", big), (None, "u", big), (10, "u10", "y" * 999), (11, "u11", "y" * 999)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1))


def archive(spark, tmp_path, df, **options):
    W.register(spark)
    path = str(tmp_path / "warc")
    W.records_of(df).write.format("warc").options(**options).mode("append").save(path)
    return path


def test_round_trip(spark, tmp_path):
    df = pages(spark)
    back = spark.read.format("warc").load(archive(spark, tmp_path, df)).collect()
    assert len(back) == df.count()
    by = {}
    for r in back:
        by.setdefault(r["record_id"], []).append(r)
    want = {r["page_id"]: (r["html"] or "").encode() for r in df.collect() if r["page_id"] is not None}
    for i, payload in want.items():
        for r in by[f"<urn:page:{i}>"]:
            assert r["payload_digest"] == "sha1:" + hashlib.sha1(payload).hexdigest() and r["payload_bytes"] == len(payload)
            assert r["payload"] == (payload if r["record_type"] == "response" else None)
    kinds = {k: {(r["record_type"], r["refers_to"]) for r in v} for k, v in by.items()}
    assert kinds["<urn:page:1>"] == {("revisit", "<urn:page:2>")} and kinds["<urn:page:2>"] == {("response", None)}
    assert kinds["<urn:page:3>"] == {("revisit", "<urn:page:4>")} and kinds[None] == {("revisit", "<urn:page:2>")}
    assert all(kinds[f"<urn:page:{i}>"] == {("response", None)} for i in (4, 5, 6, 7, 8, 9, 10, 11))


def test_any_gzip_reader_sees_the_records(spark, tmp_path):
    path = archive(spark, tmp_path, pages(spark))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "warc").glob("*.warc.gz")))
    assert text.count(b"WARC/1.1\r\nWARC-") == 13 and path


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = archive(spark, tmp_path, pages(spark))
    df = spark.read.format("warc").load(path)
    assert {r["record_id"] for r in df.where("record_type = 'revisit'").collect()} == {"<urn:page:1>", "<urn:page:3>", None}
    assert df.where("target_uri in ('u5', 'u6') and record_type = 'response'").count() == 1
    assert df.where("payload_bytes > 1500 and record_type = 'response'").count() == 2
    lean = spark.read.format("warc").option("payload", "false").load(path)
    assert lean.where("payload is not null").count() == 0 and lean.count() == 13
    reader = W.WarcReader({"path": path})
    left = list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.EqualTo(("payload_bytes",), 5)]))
    assert len(left) == 1
    seen = {}
    rows = [r for p in reader.partitions() for r in W.read_stretch(p, reader.wanted, seen)]
    assert len(rows) == 3 and seen.get("inflated", 0) == 3
    reader.wanted.payload, seen = False, {}
    assert len([r for p in reader.partitions() for r in W.read_stretch(p, reader.wanted, seen)]) == 3 and not seen


def test_small_files_and_stretches(spark, tmp_path):
    path = archive(spark, tmp_path, pages(spark).repartition(2), fileBytes="900", splitBytes="300")
    parts = W.WarcReader({"path": path}).partitions()
    assert len(parts) > 4 and any(p.start > 0 for p in parts)
    assert spark.read.format("warc").load(path).count() == 13


def test_archives_of_others(spark, tmp_path):
    """Plain files and gzip members without the extra field."""
    rows = [dict(record_id=f"<urn:page:{i}>", record_type="response", target_uri=f"u{i}") for i in range(5)]
    raw = [W.record_bytes(r, b"payload %d" % i) for i, r in enumerate(rows)]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in raw))
    W.register(spark)
    df = spark.read.format("warc").load(str(tmp_path))
    assert sorted((r["target_uri"], bytes(r["payload"])) for r in df.collect()) == sorted((f"u{i}", b"payload %d" % i) for i in range(5) for _ in range(2))
    assert df.where("target_uri = 'u3'").count() == 2


def test_uncommitted_files_are_not_read(spark, tmp_path):
    path = archive(spark, tmp_path, pages(spark))
    (tmp_path / "warc" / "part-lost.warc.gz").write_bytes(W.member(W.record_bytes({"record_type": "response"}, b"lost")))
    assert spark.read.format("warc").load(path).count() == 13


def test_empty_table(spark, tmp_path):
    path = archive(spark, tmp_path, pages(spark).limit(0))
    assert spark.read.format("warc").load(path).count() == 0


def test_overwrite_is_refused(spark, tmp_path):
    W.register(spark)
    with pytest.raises(Exception):
        W.records_of(pages(spark)).write.format("warc").mode("overwrite").save(str(tmp_path / "x"))


def test_query_reads_back_every_page(spark):
    assert W.op8_warc_archive(spark, SF001).count() == spark.read.parquet(f"{SF001}/pages.parquet").count()
