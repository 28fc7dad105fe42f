import json

import pytest
from pyspark.sql import functions as F

from siltwork.operators.merge import Snapshots
from siltwork.sources import files, mail
from siltwork.sources.config import Settings
from siltwork.streaming import ingest, windows


def test_pasted(spark, tmp_path):
    (tmp_path / "a.md").write_text("\n Title \nbody")
    r = files.pasted(spark, str(tmp_path)).first()
    assert r.title == "Title" and len(r.artifact_hash) == 64 and r.text.endswith("body")


def test_blobs_are_written_once(spark, rows, tmp_path):
    df = spark.createDataFrame([("aa1", "md", b"x"), ("aa1", "md", b"x"), ("bb2", "md", b"y"), (None, "md", b"z")], "artifact_hash string, ext string, content binary")
    for _ in range(2):
        files.write_blobs(df, str(tmp_path / "raw"))
    assert files.read_blobs(spark, str(tmp_path / "raw")).count() == 2
    assert [r.artifact_hash for r in files.read_blobs(spark, str(tmp_path / "raw"), ["bb2"]).collect()] == ["bb2"]


def test_manifests(spark, tmp_path):
    good = {"content_hash": "h", "source_type": "web", "fetched_at": "2024-01-01T00:00:00+00:00", "extra": {"from": "A"}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"source_type": "email", "fetched_at": "2024-02-01T00:00:00+00:00"}))
    assert [(r.source_type, r.extra["from"]) for r in files.manifests(spark, str(tmp_path)).collect()] == [("email", "A")]
    (tmp_path / "c.json").write_text("{broken")
    with pytest.raises(Exception):
        files.manifests(spark, str(tmp_path)).collect()
    assert files.manifests(spark, str(tmp_path), strict=False).count() == 1


def test_intermediates(spark, tmp_path):
    at = str(tmp_path / "mid")
    like = "stage string, gen_key string, payload string"
    assert files.read_intermediate(spark, at, like).count() == 0
    files.write_intermediate(spark.createDataFrame([("extract", "k1", "a"), ("extract", "k2", "b")], like), at)
    files.write_intermediate(spark.createDataFrame([("extract", "k2", "c")], like), at)
    assert sorted((r.gen_key, r.payload) for r in files.read_intermediate(spark, at, like).collect()) == [("k1", "a"), ("k2", "c")]


def test_notes_round_trip(spark):
    df = spark.range(1).select(F.lit("n.md").alias("path"), F.struct(F.lit("claim").alias("type"), F.lit(None).cast("string").alias("url")).alias("meta"), F.lit("# T\n\nBody \n").alias("body"))
    texts = files.notes_text(df)
    r = files.parse_notes(texts).first()
    assert json.loads(r.meta) == {"type": "claim", "url": None} and r.body == "# T\n\nBody"
    odd = spark.createDataFrame([("a", "no head"), ("b", "---\n: [\n---\nx"), ("c", None)], "path string, text string")
    assert [x.meta for x in files.parse_notes(odd).collect()] == [None, None, None]


EML = b"From: Ann <a@x.example>\r\nSubject: Hi\r\nDate: Mon, 1 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1@x>\r\nList-Id: <list.x>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nView this post on the web at https://x.example/1\r\nHello there\r\n"


def test_mailbox(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(EML)
    (tmp_path / "b.eml").write_bytes(b"From: Bob <b@x.example>\r\nSubject: empty\r\n\r\n  \r\n")
    spark.dataSource.register(mail.MailboxSource)
    df = spark.read.format("mailbox").option("path", str(tmp_path)).load()
    assert df.count() == 2
    r = mail.messages_to_artifacts(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.title, r.source, r.source_url, r.message_id, r.word_count) == ("Hi", "<list.x>", "https://x.example/1", "<1@x>", 2)


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"models": {"dedup": {"provider": "p", "model": "m"}}}))
    s = Settings.load(str(p))
    assert (s.max_distance, s.shortlist, s.model("dedup").prompt_version) == (0.6, 5, "v1")
    with pytest.raises(ValueError):
        s.model("other")


def test_stream_keeps_latest_in_any_order(spark, rows, tmp_path):
    schema = "id string, at int, v string"
    store = Snapshots(spark, str(tmp_path / "t"), schema)
    src = str(tmp_path / "in")
    for n, data in enumerate([[("a", 2, "new"), ("b", 1, "b")], [("a", 1, "old"), ("c", 1, "c")]]):
        spark.createDataFrame(data, schema).write.mode("append").parquet(src)
        ingest.keep_latest(spark.readStream.schema(schema).parquet(src), store, ["id"], ["at"], str(tmp_path / "cp"))
    assert rows(store.read()) == [("a", 2, "new"), ("b", 1, "b"), ("c", 1, "c")]


def test_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double")
    got = sorted((str(r.start), r.n, r.value) for r in windows.tumbling(e.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect())
    assert got == [("2024-01-01 00:00:00", 2, 3.0), ("2024-01-01 01:00:00", 1, 4.0)]
