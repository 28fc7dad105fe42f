import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltwork import schemas
from siltwork.operators import backlog as B
from siltwork.operators import compare, facts, graph, providers, similarity
from siltwork.operators.merge import Snapshots, latest, upsert, without
from siltwork.plans.queries import QUERIES


def test_latest_and_upsert(spark, rows):
    old = spark.createDataFrame([("a", 1, "x", "k"), ("b", 2, "y", "k")], "id string, n int, s string, c string")
    new = spark.createDataFrame([("b", None, None, "z"), ("d", 4, "w", None)], old.schema)
    got = rows(upsert(old, new, ["id"], {"s": "coalesce", "c": "old"}))
    assert got == sorted([("a", 1, "x", "k"), ("b", None, "y", "k"), ("d", 4, "w", None)], key=repr)
    assert rows(without(old, new, ["id"])) == [("a", 1, "x", "k")]
    many = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", None)], "id string, n int")
    assert rows(latest(many, ["id"], F.col("n").desc_nulls_last())) == [("a", 3), ("b", None)]


def test_snapshots(spark, rows, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"), "id string, n int")
    assert rows(t.read()) == []
    t.merge(spark.createDataFrame([("a", 1)], "id string, n int"), ["id"])
    before = t.read()
    t.merge(spark.createDataFrame([("a", 2), ("b", 1)], "id string, n int"), ["id"])
    assert rows(t.read()) == [("a", 2), ("b", 1)] and rows(before) == [("a", 1)]


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: min(y for y in linked if root(y) == root(x)) for x in linked}
    assert graph.components(spark.createDataFrame([], "a int, b int")).collect() == []


ART = "artifact_hash string, source_type string, author string, source string, media string, title string, word_count int, created_at timestamp_ntz"


@pytest.fixture(scope="module")
def registry(spark):
    data = [("h1", "email", "Ann", None, "text", "Alpha 100%", 1, "2024-01-01 00:00:00"), ("h2", "paste", "Bob", "s", "text", "Beta", 2, "2024-01-02 00:00:00"), ("h3", "paste", None, None, "audio", None, 3, "2024-01-02 00:00:00")]
    return spark.createDataFrame(data, ART.replace("timestamp_ntz", "string")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def jobs(spark):
    data = [("h1", "source_note", "done"), ("h1", "extract_claims", "ready"), ("h2", "source_note", "done"), ("h2", "dedup", "done"), ("h9", "source_note", "failed"), ("h9", "odd", "running"), ("h8", "source_note", "pending")]
    return spark.createDataFrame(data, "artifact_hash string, stage string, status string").withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def hashes(df):
    return sorted(r.artifact_hash for r in df.collect())


def test_backlog(registry, jobs):
    assert hashes(B.backlog(registry, jobs, {"search": "bet"})) == ["h2"]
    assert hashes(B.backlog(registry, jobs, {"search": "100%"})) == ["h1"] and hashes(B.backlog(registry, jobs, {"search": "a_p"})) == []
    assert hashes(B.backlog(registry, jobs, {"source_type": "paste", "author": ""})) == ["h2", "h3"]
    assert hashes(B.backlog(registry, jobs, {"hide_completed": True})) == ["h1"]
    assert hashes(B.backlog(registry, jobs, {"status": "done"})) == ["h2"]
    assert [r.artifact_hash for r in B.page(registry, 0, 2).collect()] == ["h2", "h3"]
    assert [r.artifact_hash for r in B.page(registry, 2, 2).collect()] == ["h1"]
    assert tuple(B.pages(registry.limit(0)).first()) == (0, 1) and tuple(B.pages(registry, 2).first()) == (3, 2)


def test_progress(spark, rows, registry, jobs):
    assert {r.artifact_hash: r.current_status for r in B.current_status(jobs).collect()} == {"h1": "ready", "h2": "done", "h9": "failed", "h8": "done"}
    stages = ("source_note", "extract_claims", "dedup", "entities")
    f = {r.artifact_hash: tuple(r)[1:] for r in B.frontier(jobs, stages).collect()}
    assert f == {"h1": (1, 2, "extract_claims", "ready"), "h2": (2, 2, None, None), "h9": (0, 2, "source_note", "failed"), "h8": (0, 1, "source_note", "pending")}
    assert hashes(B.unregistered(jobs, registry)) == ["h8", "h9"]
    t = [tuple(r)[:4] for r in B.timeline(jobs.where("artifact_hash = 'h1'"), jobs, stages).orderBy("ord").collect()]
    assert [(r[1], r[3]) for r in sorted(t, key=lambda r: stages.index(r[1]))] == [("source_note", "done"), ("extract_claims", "ready"), ("dedup", None), ("entities", None)]
    refs = spark.createDataFrame([("H1",), ("h",), ("zz",), (None,), ("h1",)], "ref string")
    assert rows(B.resolve_prefixes(refs, registry)) == [("H1", "h1"), ("h1", "h1")]
    assert {(r.facet, r.value) for r in B.facet_values(registry).collect() if r.facet != "media"} == {("source_type", "email"), ("source_type", "paste"), ("author", "Ann"), ("author", "Bob"), ("source", "s")}


def test_overrides_and_limits(spark, rows, jobs):
    c = spark.createDataFrame([("global", "*", "paused"), ("stage", "dedup", "running"), ("artifact", "h2", "paused"), ("source_type", "", "held")], "scope string, key string, state string")
    scopes = {"artifact": F.col("artifact_hash"), "stage": F.col("stage"), "global": F.lit("*")}
    got = {(r.artifact_hash, r.stage): r.state for r in B.first_override(jobs, c, scopes, "running").collect()}
    assert got["h2", "dedup"] == "paused" and got["h1", "extract_claims"] == "paused" and len(got) == 7
    by_type = B.first_override(jobs.withColumn("t", F.lit(None).cast("string")), c, {"source_type": F.col("t")}, "running")
    assert {r.state for r in by_type.collect()} == {"held"}
    few = B.first_of_each(jobs, spark.createDataFrame([("source_note", 2)], "stage string, batch_limit int"), "stage", F.col("artifact_hash"))
    assert sorted((r.stage, r.artifact_hash) for r in few.collect()) == [("dedup", "h2"), ("extract_claims", "h1"), ("odd", "h9"), ("source_note", "h1"), ("source_note", "h2")]


def test_knn(spark, rows):
    index = spark.createDataFrame([("c1", [1.0, 0.0, 0.0]), ("c2", [0.0, 1.0, 0.0]), ("bad", [1.0]), ("none", None)], "item_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [0.9, 0.1, 0.0])], index.schema)
    assert [r.item for r in similarity.knn(q, index, 5).orderBy("rank").collect()] == ["c1", "c2"]
    assert [r.item for r in similarity.knn(q, index, 5, 0.2).collect()] == ["c1"]
    assert similarity.knn(q, index.limit(0), 5).collect() == []


def test_knn_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS", 50)
    monkeypatch.setattr(similarity, "QUERIES", 7)
    x = np.round(np.random.default_rng(1).normal(size=(150, 4)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id bigint, embedding array<float>")
    got = {(r.query, r["rank"]): r.item for r in similarity.knn(df.where("item_id % 10 = 0"), df, 6).collect()}
    x = x.astype(np.float32).astype(float)
    for i in range(0, 150, 10):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6)
        d[i] = 9e9
        assert [got[i, k + 1] for k in range(6)] == list(np.argsort(d, kind="stable")[:6])


def test_leaders_against_one_pass(spark):
    rng = random.Random(2)
    pos = {i: rng.random() for i in range(150)}
    near = [(a, b, abs(pos[a] - pos[b])) for a, b in itertools.combinations(range(150), 2) if abs(pos[a] - pos[b]) <= 0.004]
    led = {}
    for x in range(150):
        hits = sorted((abs(pos[x] - pos[y]), y) for y in led if led[y] == y and abs(pos[x] - pos[y]) <= 0.004)
        led[x] = hits[0][1] if hits else x
    items = spark.createDataFrame([(i, i) for i in range(150)], "item int, ord int").withColumnRenamed("item", "id")
    got = similarity.leaders(items, spark.createDataFrame(near, "a int, b int, distance double"), "id")
    assert {r.item: r.leader for r in got.collect()} == led


def test_all_pairs_within_a_distance(spark, rows, monkeypatch):
    monkeypatch.setattr(similarity, "SIDE", 16)
    monkeypatch.setattr(similarity, "PAIRS", 10)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 4)).round(1)
    data = [(f"v{i:02}", x.tolist()) for i, x in enumerate(v)] + [("odd", [0.0]), ("none", None), (None, [0.0] * 4)]
    want = [(f"v{i:02}", f"v{j:02}", d) for i, j in itertools.combinations(range(90), 2) if (d := round(float(np.sqrt(((v[i] - v[j]) ** 2).sum())), 6)) <= 1.0]
    got = rows(similarity.within(spark.createDataFrame(data, "item_id string, embedding array<double>"), 1.0))
    assert got == want and len(want) > 90 and any(d == 1.0 for _, _, d in want)


def test_leader_clusters_take_links_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(260, 3)).astype("float32")
    spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    led = {}
    for i, x in enumerate(v.astype(float)):
        hits = [(d, y) for y in led if led[y] == y and (d := round(float(np.sqrt(((x - v[y - 1].astype(float)) ** 2).sum())), 6)) <= 1.2]
        led[i + 1] = min(hits)[1] if hits else i + 1
    assert {r.item: r.leader for r in QUERIES["leader_clusters"](spark, str(tmp_path)).collect()} == led


def test_facts(spark, rows):
    c = spark.createDataFrame([("c1", "x", 1, "s1"), ("c2", "x", 2, "s1"), ("c3", "y", 3, "s2"), ("c4", "x", 0, "s3")], "id string, said string, seq int, src string")
    got = facts.attest(c, F.col("said"), F.col("seq"))
    assert {r.id: (r.claim, r.is_new) for r in got.collect()} == {"c1": ("c4", False), "c2": ("c4", False), "c4": ("c4", True), "c3": ("c3", True)}
    assert rows(facts.attestation_counts(got, F.col("src"))) == [("c3", 1, 1), ("c4", 3, 2)]
    listed = facts.accumulate(got, "claim", ["id"], "seq")
    assert {r.claim: [x.id for x in r["items"]] for r in listed.collect()} == {"c4": ["c4", "c1", "c2"], "c3": ["c3"]}


def test_entity_ids_avoid_taken_ones(spark):
    names = ["a", "a-2", "A", "a!", "a-3", "b", "!!", ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "seq int, name string")
    got = {r.seq: r.entity_id for r in facts.entity_ids(df, "seq").collect()}
    assert got == {0: "a", 1: "a-2", 2: "a-4", 3: "a-5", 4: "a-3", 5: "b", 6: "entity", 7: "entity-2"}


def test_providers(spark):
    class Failing(providers.LineProvider):
        def complete(self, text, model):
            if "bad" in text:
                raise RuntimeError("no answer")
            return super().complete(text, model)

    df = spark.createDataFrame([("a", "one\n\ntwo words", "m"), ("b", "bad", "m"), ("c", None, "m")], "id string, text string, model string")
    got = {r.id: r for r in providers.complete(df, Failing()).collect()}
    assert got["a"].tokens_in == 3 and got["a"].error is None and "two words" in got["a"].answer
    assert got["b"].answer is None and "no answer" in got["b"].error and got["c"].answer is None
    vectors = providers.embed(df, providers.LineProvider(), id_="id").collect()
    assert len(vectors) == 2 and all(len(v.embedding) == 8 for v in vectors)


def test_comparison(spark, rows):
    docs = spark.createDataFrame([("h1", "a\nb\nc\nd"), ("h2", "x")], "artifact_hash string, text string")
    variants = spark.createDataFrame([(0, "lines", "one", "v1", {"t": "0"}), (1, "lines", "two", "v1", {})], "index int, provider string, model string, prompt_version string, params map<string,string>")
    got = compare.run(docs, variants, providers.LineProvider(by_model={"one": 1, "two": 2})).cache()
    assert got.select("gen_key").distinct().count() == 4
    assert compare.pending(got, got.where("index = 0")).count() == 2
    counted = got.withColumn("outputs", F.when(F.col("answer").isNull(), 0).otherwise(F.size(F.from_json("answer", "array<string>"))))
    assert rows(compare.report(counted).select("index", "inputs", "outputs")) == [(0, 2, 2), (1, 2, 3)]
    assert compare.report_table(compare.report(counted)).orderBy("index").first().line == "| 0 | lines | one | 2 | 5/2 |"
    assert compare.approve(got, spark.createDataFrame([("h1", 1)], "artifact_hash string, index int")).count() == 1


def test_migration(spark):
    old = spark.createDataFrame([("c1", "t", 9)], "claim_id string, text string, extra int")
    new = schemas.migrate(old, "claims")
    assert new.columns == [*schemas.schema("claims").fieldNames(), "extra"] and new.first().attestations is None
