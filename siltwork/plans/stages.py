"""Queries of whole stages and of what is kept beside them: resolution, ledgers, upserts, progress; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork import schemas
from siltwork.functions import keys, notes
from siltwork.functions import text as T
from siltwork.functions import vectors as V
from siltwork.operators import backlog as B
from siltwork.operators import cascade, compare, facts, providers, similarity
from siltwork.operators.merge import Snapshots, latest, upsert, without
from siltwork.plans.queries import AS_OF, JOBS, REG, ROWS, STAGES, backlog_rows, events, jobs, query, registry, variant_results
from siltwork.session import cut, table
from siltwork.sources import files
from siltwork.streaming import ingest

# Resolution of claims and entities.

_USABLE = """u AS (SELECT item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM vectors WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT item_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM u)"""
_WALK = """pairs AS MATERIALIZED (SELECT a.i AS i, b.i AS j, round(list_distance(x.v, y.v), 6) AS d, {same} AS same FROM cand a JOIN n x ON x.item_id = a.key JOIN cand b ON b.i < a.i JOIN n y ON y.item_id = b.key
  WHERE round(list_distance(x.v, y.v), 6) <= 0.6),
g AS MATERIALIZED (SELECT i, list(struct_pack(d := d, j := j, same := same) ORDER BY d, b) AS near, row_number() OVER (ORDER BY i) AS step FROM (SELECT pairs.*, cand.id AS b FROM pairs JOIN cand ON cand.i = j) GROUP BY i),
last AS MATERIALIZED (SELECT count(*) AS n FROM g),
r AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS joined, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS hit UNION ALL
  SELECT step, CASE WHEN hit IS NULL THEN joined ELSE list_append(joined, i) END, i, hit FROM (
    SELECT g.step, r.joined, g.i, list_filter(list_filter(near, lambda x: NOT list_contains(r.joined, x.j))[1:5], lambda x: x.same)[1].j AS hit
    FROM r JOIN g ON g.step = r.step + 1)),
led AS (SELECT i, hit FROM r WHERE hit IS NOT NULL)"""


def claim_candidates_rows(s: SparkSession, d: str) -> DataFrame:
    first = table(s, d, "claims").where("text is not null").groupBy("claim_id").agg(F.min("batch_no").alias("b"), F.min("created_at").alias("seen"), F.min("text").alias("text"))
    v = table(s, d, "vectors").select(F.col("item_id").alias("claim_id"), "embedding")
    return first.join(v, "claim_id", "left").select(F.col("claim_id").alias("id"), F.struct("b", "seen", "claim_id").alias("ord"), "text", "embedding")


def same_figures(a, b):
    figures = lambda c: F.regexp_extract_all(c["text"], F.lit("([0-9.]+)"), F.lit(1))
    return figures(a) == figures(b)


@query(
    f"""WITH RECURSIVE cand AS (SELECT claim_id AS id, claim_id AS key, text, row_number() OVER (ORDER BY b, seen, claim_id) AS i
  FROM (SELECT claim_id, min(batch_no) AS b, min(created_at) AS seen, min(text) AS text FROM claims WHERE text IS NOT NULL GROUP BY 1)), {_USABLE},
{_WALK.format(same="regexp_extract_all(a.text, '[0-9.]+') = regexp_extract_all(b.text, '[0-9.]+')")}
SELECT c.id, coalesce(l.id, c.id) AS resolved, l.id IS NULL AS is_new FROM cand c LEFT JOIN led ON led.i = c.i LEFT JOIN cand l ON l.i = led.hit"""
)
def dedup_stage(s, d):
    return cascade.resolve(claim_candidates_rows(s, d), same_figures)


@query(
    """WITH c AS (SELECT claim_id AS id, min(batch_no) AS b, min(text) AS text FROM claims WHERE text IS NOT NULL GROUP BY 1)
SELECT count(*) AS held FROM (SELECT DISTINCT regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') FROM c)"""
)
def claim_index_runs(s, d):
    """The history, then the new batches, against an index kept as snapshots; confirmed by equal folded text."""
    folded = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")
    c = table(s, d, "claims").where("text is not null").groupBy("claim_id").agg((F.min("batch_no") > 0).cast("int").alias("b"), F.min("text").alias("text"))
    # Equal folded texts have equal embeddings here, so that they are always in reach.
    rows = cut(c.select(F.col("claim_id").alias("id"), "b", F.struct("b", "claim_id").alias("ord"), folded.alias("text"), V.hash_embedding(folded).alias("embedding")), "claims")
    index = Snapshots(s, ingest.new_folder(s, "claim-index"), "id string, ord struct<b:int,claim_id:string>, text string, embedding array<double>")
    for n in sorted(r[0] for r in rows.select("b").distinct().collect()):
        cascade.take_batch(index, rows.where(F.col("b") == n).drop("b"), lambda x, y: x["text"] == y["text"], max_distance=0.0, dimensions=8)
    return index.read().agg(F.count(F.lit(1)).alias("held"))


_MENTIONS = """m AS (SELECT entity_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, coalesce(lower(entity_type), 'other') AS type, row_number() OVER (ORDER BY created_at, entity_id) AS ord FROM entities WHERE trim(name) <> ''),
f AS (SELECT *, min(ord) OVER (PARTITION BY name, type) AS first FROM m)"""


def mentions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "entities").where(F.trim("name") != "")
    return e.select("entity_id", F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name"), F.coalesce(F.lower("entity_type"), F.lit("other")).alias("type"), F.struct("created_at", "entity_id").alias("ord"))


_LETTERS = "list_sort(list_distinct(string_split(regexp_replace(lower({}), '[^a-z]', '', 'g'), '')))"


@query(
    f"""WITH RECURSIVE {_MENTIONS}, cand AS (SELECT entity_id AS id, entity_id AS key, name, ord, row_number() OVER (ORDER BY ord) AS i, regexp_replace(lower(name), '[^a-z]', '', 'g') AS bare FROM f WHERE ord = first),
n AS (SELECT id AS item_id, list_transform(list_transform(range(26), lambda k: CAST(len(bare) - len(replace(bare, chr(97 + CAST(k AS INT)), '')) AS DOUBLE)),
  lambda x: x / greatest(sqrt(list_sum(list_transform(range(26), lambda k: CAST(pow(len(bare) - len(replace(bare, chr(97 + CAST(k AS INT)), '')), 2) AS DOUBLE)))), 1e-300)) AS v FROM cand WHERE bare <> ''),
{_WALK.format(same="a.bare[1:4] = b.bare[1:4]").replace("<= 0.6", "<= 0.3")}
SELECT f.entity_id AS mention, coalesce(l.id, c.id) AS entity, CASE WHEN f.ord <> f.first THEN 'exact' WHEN l.id IS NULL THEN 'new' ELSE 'near' END AS how
FROM f JOIN cand c ON c.ord = f.first LEFT JOIN led ON led.i = c.i LEFT JOIN cand l ON l.i = led.hit"""
)
def entity_stage(s, d):
    """Mentions of entities: exact by name and type, then the nearest by letter counts confirmed by their beginning, else new."""
    found = cut(cascade.exact_first(mentions(s, d)), "mentions")
    bare = F.regexp_replace(F.lower("name"), "[^a-z]", "")
    counts = F.array(*(F.length("bare") - F.length(F.replace("bare", F.lit(chr(97 + k)))) for k in range(26)))
    first = found.where("is_first").select(F.col("entity_id").alias("id"), "ord", bare.alias("bare")).withColumn("embedding", counts.cast("array<double>"))
    led = cascade.resolve(first, lambda a, b: F.substring(a["bare"], 1, 4) == F.substring(b["bare"], 1, 4), max_distance=0.3, dimensions=26)
    how = F.when(~F.col("is_first"), "exact").when(F.col("is_new"), "new").otherwise("near")
    by = led.select(F.col("id").alias("lead"), "resolved", "is_new")
    return found.join(by, F.col("first.entity_id") == F.col("lead")).select(F.col("entity_id").alias("mention"), F.col("resolved").alias("entity"), how.alias("how"))


@query(
    """WITH p AS (SELECT a.vec_id AS query, b.vec_id AS item, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, item) AS rank FROM p)
SELECT query, item, CAST(rank AS INT) AS rank, source FROM r JOIN documents ON doc_id = item WHERE rank <= 5 AND source IS NOT NULL"""
)
def knn_with_metadata(s, d):
    e = table(s, d, "embeddings")
    hits = similarity.knn(e.where("vec_id % 100 = 0"), e, 5, None, "vec_id")
    return similarity.with_metadata(hits, table(s, d, "documents").where("source is not null").select(F.col("doc_id").alias("item"), "source")).select("query", "item", "rank", "source")


# Backlog, progress and limits.


@query(f"WITH {JOBS} SELECT * FROM jobs WHERE artifact_id = 31 AND stage = 'dedup'")
def point_lookup(s, d):
    return jobs(s, d).where("artifact_id = 31 and stage = 'dedup'")


@query(f"WITH {JOBS} SELECT artifact_id, arg_min(stage, (updated_at, stage)) AS stage FROM jobs WHERE status = 'ready' GROUP BY 1")
def oldest_ready(s, d):
    return B.oldest(jobs(s, d).where("status = 'ready'"), "artifact_id", F.col("updated_at"), F.col("stage"))


@query(f"WITH {JOBS} SELECT coalesce(stage, '*') AS stage, count(*) AS done FROM jobs WHERE status = 'done' GROUP BY GROUPING SETS ((stage), ())")
def run_tally(s, d):
    return B.tally(jobs(s, d), "stage")


@query(f"WITH {JOBS}, {ROWS}, p AS (SELECT artifact_id, count(*) FILTER (status = 'done') AS done, count(*) AS total FROM jobs GROUP BY 1), b AS (SELECT * FROM backlog ORDER BY created_at DESC, artifact_id LIMIT 50) SELECT b.artifact_id, title, coalesce(done, 0) AS done, coalesce(total, 0) AS total FROM b LEFT JOIN p USING (artifact_id)")
def page_progress(s, d):
    shown = B.page(backlog_rows(s, d), key="artifact_id").select("artifact_id", "title")
    return B.with_progress(shown, jobs(s, d), STAGES, "artifact_id").select("artifact_id", "title", "done", "total")


@query(
    f"""WITH {JOBS}, t AS (SELECT jobs.*, source_type FROM jobs LEFT JOIN documents ON doc_id = artifact_id WHERE status = 'ready'),
r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY updated_at, artifact_id) AS a, row_number() OVER (PARTITION BY source_type ORDER BY updated_at, artifact_id, stage) AS b FROM t)
SELECT artifact_id, stage FROM r WHERE (stage <> 'dedup' OR a <= 20) AND (source_type IS DISTINCT FROM 'email' OR b <= 15)"""
)
def throttled_ready(s, d):
    kinds = table(s, d, "documents").select(F.col("doc_id").alias("artifact_id"), "source_type")
    rows = jobs(s, d).where("status = 'ready'").join(kinds, "artifact_id", "left")
    stage = s.createDataFrame([("dedup", 20)], "stage string, batch_limit int")
    kind = s.createDataFrame([("email", 15)], "source_type string, batch_limit int")
    by_stage = B.first_of_each(rows, stage, "stage", F.col("updated_at"), F.col("artifact_id")).select("artifact_id", "stage")
    by_kind = B.first_of_each(rows, kind, "source_type", F.col("updated_at"), F.col("artifact_id"), F.col("stage")).select("artifact_id", "stage")
    return by_stage.join(by_kind, ["artifact_id", "stage"])


@query(f"WITH {JOBS}, g AS (SELECT stage, status, count(*) AS n FROM jobs GROUP BY 1, 2) SELECT stage, status, n, CAST(row_number() OVER (ORDER BY stage, status) AS INT) AS place FROM g")
def ordered_listing(s, d):
    return B.listing(jobs(s, d).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n")), "stage", "status")


@query(f"WITH {JOBS} SELECT artifact_id, stage FROM jobs WHERE status IN ('done', 'held') AND stage <> 'entities' AND NOT EXISTS (SELECT 1 FROM jobs q WHERE q.artifact_id = jobs.artifact_id AND q.status IN ('ready', 'running'))")
def enqueue_new(s, d):
    j = jobs(s, d)
    wanted = j.where(F.col("status").isin("done", "held") & (F.col("stage") != "entities")).select("artifact_id", "stage")
    return without(wanted, j.where(F.col("status").isin("ready", "running")), ["artifact_id"])


@query("SELECT DISTINCT model FROM claims WHERE model IS NOT NULL UNION SELECT DISTINCT 'embed-' || lang FROM documents WHERE lang IS NOT NULL")
def models_in_use(s, d):
    named = table(s, d, "claims").select("model").where("model is not null")
    return named.union(table(s, d, "documents").where("lang is not null").select(F.concat(F.lit("embed-"), "lang"))).distinct()


# Upserts and ledgers.

_OLD = "updated_at < TIMESTAMP '2024-01-16 00:00:00'"


@query(
    f"""WITH {JOBS}, o AS (SELECT *, 2 AS attempts, 'late' AS error, 'in/' || stage AS input_path FROM jobs WHERE {_OLD}),
x AS (SELECT artifact_id, stage, 'ready' AS status, 0 AS attempts, CAST(NULL AS VARCHAR) AS error, 'again/' || stage AS input_path FROM jobs WHERE status = 'failed')
SELECT coalesce(x.artifact_id, o.artifact_id) AS artifact_id, coalesce(x.stage, o.stage) AS stage, CASE WHEN x.stage IS NULL THEN o.status ELSE x.status END AS status,
  CASE WHEN x.stage IS NULL THEN o.attempts ELSE 0 END AS attempts, CASE WHEN x.stage IS NULL THEN o.error END AS error, CASE WHEN x.stage IS NULL THEN o.input_path ELSE x.input_path END AS input_path,
  CASE WHEN o.stage IS NULL THEN TIMESTAMP '{AS_OF}' ELSE o.updated_at END AS created_at
FROM o FULL JOIN x ON o.artifact_id = x.artifact_id AND o.stage = x.stage"""
)
def job_upsert(s, d):
    """Jobs queued again: state, input and attempts are the new ones, the time of the first is kept."""
    j = jobs(s, d)
    old = j.where(_OLD).select("artifact_id", "stage", "status", F.lit(2).alias("attempts"), F.lit("late").alias("error"), F.concat(F.lit("in/"), "stage").alias("input_path"), F.col("updated_at").alias("created_at"))
    new = j.where("status = 'failed'").select(
        "artifact_id", "stage", F.lit("ready").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("again/"), "stage").alias("input_path"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("created_at"),
    )
    return upsert(old, new, ["artifact_id", "stage"], {"created_at": "old"})


@query(
    """WITH o AS (SELECT 'source' AS scope, source AS key, 'paused' AS state, CAST(count(*) AS INT) AS batch_limit, 'old' AS note FROM documents WHERE source IS NOT NULL GROUP BY 2),
x AS (SELECT source AS key, CASE WHEN min(source) < 'n' THEN 'running' END AS state, CAST(NULL AS INT) AS batch_limit, max(source_type) AS note FROM artifacts WHERE source IS NOT NULL GROUP BY 1)
SELECT 'source' AS scope, coalesce(x.key, o.key) AS key, coalesce(x.state, o.state, 'running') AS state, coalesce(x.batch_limit, o.batch_limit) AS batch_limit, coalesce(x.note, o.note) AS note
FROM o FULL JOIN x ON o.key = x.key WHERE coalesce(x.key, o.key) NOT IN (SELECT source FROM artifacts WHERE source_type = 'podcast' AND source IS NOT NULL)"""
)
def control_upsert(s, d):
    """Controls set field by field, what is not given stays; those of podcasts are cleared."""
    a = table(s, d, "artifacts").where("source is not null")
    old = table(s, d, "documents").where("source is not null").groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).cast("int").alias("batch_limit"))
    old = old.select(F.lit("source").alias("scope"), "key", F.lit("paused").alias("state"), "batch_limit", F.lit("old").alias("note"))
    new = a.groupBy(F.col("source").alias("key")).agg(F.max("source_type").alias("note"))
    new = new.select(F.lit("source").alias("scope"), "key", F.when(F.col("key") < "n", "running").alias("state"), F.lit(None).cast("int").alias("batch_limit"), "note")
    both = upsert(old, new, ["scope", "key"], {"state": "coalesce", "batch_limit": "coalesce", "note": "coalesce"}).withColumn("state", F.coalesce("state", F.lit("running")))
    return without(both, a.where("source_type = 'podcast'").select(F.lit("source").alias("scope"), F.col("source").alias("key")), ["scope", "key"])


@query(
    f"""WITH {_USABLE}, c AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY attestations DESC, created_at DESC) AS rn FROM claims)
SELECT claim_id, text, model, attestations, round(CAST(CAST(v[1] AS FLOAT) AS DOUBLE), 6) AS first FROM c LEFT JOIN u ON item_id = claim_id WHERE rn = 1"""
)
def claim_index_replace(s, d):
    """Claims and their vectors inserted or replaced by key in one snapshot, vectors packed and of one dimension."""
    c = table(s, d, "claims")
    newest = latest(c, ["claim_id"], F.col("attestations").desc(), F.col("created_at").desc_nulls_last())
    v = table(s, d, "vectors").where(cascade.usable(F.col("embedding"), 64)).select(F.col("item_id").alias("claim_id"), V.packed(V.checked(F.col("embedding"), 64)).alias("embedding"))
    store = Snapshots(s, ingest.new_folder(s, "claims"), "claim_id string, text string, model string, attestations int, embedding array<float>")
    rows = newest.join(v, "claim_id", "left").select("claim_id", "text", "model", "attestations", "embedding")
    store.merge(rows.where("attestations > 1"), ["claim_id"])
    store.merge(rows, ["claim_id"])
    return store.read().select("claim_id", "text", "model", "attestations", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT event_type AS stage, user_id % 7 AS gen_key, count(*) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS tokens_in, round(sum(value), 6) AS usd FROM events GROUP BY 1, 2")
def cost_ledger(s, d):
    """Costs appended run by run to a ledger that is only added to; usage by generating key."""
    folder = ingest.new_folder(s, "costs")
    rows = events(s, d).select(F.col("event_type").alias("stage"), (F.col("user_id") % 7).alias("gen_key"), F.col("k").alias("tokens_in"), F.col("value").alias("usd"), (F.col("event_id") % 2).alias("run"))
    for run in (0, 1):
        facts.append_costs(rows.where(F.col("run") == run).drop("run"), folder)
    return facts.usage(s.read.parquet(folder), "stage", "gen_key")


@query(
    """WITH v AS (SELECT unnest([0, 1, 2]) AS index), c AS (SELECT doc_id, doc_id % 3 AS index, source_type FROM documents WHERE text IS NOT NULL)
SELECT c.doc_id, CAST(c.index AS INT) AS index, 'dedup' AS stage, 'ready' AS status FROM c JOIN v USING (index)"""
)
def approve_next(s, d):
    r = variant_results(s, d).select("doc_id", "index")
    choices = r.select("doc_id").distinct().withColumn("index", (F.col("doc_id") % 3).cast("int"))
    chain = B.next_stages(s, {"default": STAGES})
    return compare.queue_next(compare.approve(r, choices, "doc_id"), chain, "extract_claims").select("doc_id", "index", "stage", "status")


# Storage.


@query("SELECT sha256(text) AS artifact_hash, count(DISTINCT text) AS n, min(len(text)) AS chars FROM documents WHERE text <> '' GROUP BY 1")
def blob_roundtrip(s, d):
    folder = ingest.new_folder(s, "blobs")
    docs = table(s, d, "documents").where("text <> ''").select(T.content_hash(F.col("text")).alias("artifact_hash"), F.lit(".md").alias("ext"), F.col("text").cast("binary").alias("content"))
    files.write_blobs(docs, folder)
    files.write_blobs(docs, folder)
    return files.read_blobs(s, folder).groupBy("artifact_hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.length(T.decoded(F.col("content")))).cast("bigint").alias("chars"))


@query("SELECT sha256(n_name) AS artifact_hash, n_name AS title FROM nation WHERE n_regionkey IN (1, 3)")
def blobs_by_hash(s, d):
    """Blobs read by a list of hashes: only their parts of the store are touched."""
    folder = ingest.new_folder(s, "blobs")
    rows = table(s, d, "nation").select(T.content_hash(F.col("n_name")).alias("artifact_hash"), F.lit(".txt").alias("ext"), F.col("n_name").cast("binary").alias("content"), "n_regionkey")
    files.write_blobs(rows.drop("n_regionkey"), folder)
    named = [r[0] for r in rows.where("n_regionkey in (1, 3)").select("artifact_hash").collect()]
    return files.read_blobs(s, folder, named).select("artifact_hash", T.decoded(F.col("content")).alias("title"))


@query("SELECT n_name AS text, sha256(n_name || chr(10)) AS artifact_hash, n_name AS title, 'paste' AS source_type FROM nation")
def pasted_texts(s, d):
    folder = ingest.new_folder(s, "pasted")
    table(s, d, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return files.pasted(s, f"{folder}/*/*.txt").select(F.rtrim("text", F.lit("\n")).alias("text"), "artifact_hash", "title", "source_type")


@query(
    """SELECT content_hash, source_type, source_url, fetched_at, ext, annotates, extra['subject'] AS subject FROM (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY fetched_at DESC NULLS LAST) AS rn FROM manifest WHERE content_hash IS NOT NULL) WHERE rn = 1"""
)
def manifest_roundtrip(s, d):
    """Manifests written as JSON beside the blobs and read back strictly, the newest of each hash."""
    folder = ingest.new_folder(s, "manifests")
    table(s, d, "manifest").write.json(folder)
    return files.manifests(s, folder, lines=True).select("content_hash", "source_type", "source_url", "fetched_at", "ext", "annotates", F.col("extra")["subject"].alias("subject"))


@query("SELECT claim_id, batch_no, max(CASE WHEN batch_no % 2 = 0 THEN 'again' ELSE 'once' END) AS state FROM claims GROUP BY 1, 2")
def keyed_intermediates(s, d):
    """Results of a stage by key; the keys that are written again replace their own parts only."""
    folder = ingest.new_folder(s, "intermediates")
    rows = table(s, d, "claims").select("claim_id", "batch_no").distinct().withColumn("stage", F.lit("extract_claims")).withColumn("gen_key", F.concat(F.lit("k"), "batch_no"))
    files.write_intermediate(rows.withColumn("state", F.lit("once")), folder)
    files.write_intermediate(rows.where("batch_no % 2 = 0").withColumn("state", F.lit("again")), folder)
    return files.read_intermediate(s, folder, "claim_id string, batch_no int, state string").select("claim_id", "batch_no", "state")


@query(
    """SELECT 'corpus/sources/' || content_hash || '.md' AS path, 'source' AS type, 'derived' AS authority, source_type || '-' || content_hash[1:8] AS heading, strftime(CAST(fetched_at AS TIMESTAMP), '%Y-%m-%d') AS derived_at FROM (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY fetched_at DESC NULLS LAST, source_url DESC NULLS LAST) AS rn FROM manifest) WHERE rn = 1 AND fetched_at IS NOT NULL"""
)
def notes_roundtrip(s, d):
    """Notes written with their frontmatter, read back and parsed."""
    m = latest(table(s, d, "manifest"), ["content_hash"], F.col("fetched_at").desc_nulls_last(), F.col("source_url").desc_nulls_last()).where("fetched_at is not null")
    meta = notes.source_note(F.col("content_hash"), F.col("fetched_at").cast("timestamp_ntz"), "1", F.col("source_type"), F.col("source_url"))
    id_ = keys.note_id(F.col("source_type"), F.col("content_hash"))
    body = notes.source_body(id_, F.col("content_hash"), F.col("source_type"), F.col("fetched_at"), F.col("source_url"))
    text = files.notes_text(m.select(F.concat(F.lit("corpus/sources/"), "content_hash", F.lit(".md")).alias("path"), meta.alias("meta"), body.alias("body")))
    read = files.parse_notes(cut(text, "notes"))
    field = lambda n: F.get_json_object("meta", f"$.{n}").alias(n)
    return read.select("path", field("type"), field("authority"), F.regexp_extract("body", "^# (.*)", 1).alias("heading"), field("derived_at"))


@query("SELECT mail_id, subject FROM (SELECT *, row_number() OVER (ORDER BY mail_id DESC) AS rn FROM mail_messages WHERE subject IS NOT NULL) WHERE rn <= 50")
def newest_mails(s, d):
    return table(s, d, "mail_messages").where("subject is not null").orderBy(F.desc("mail_id")).limit(50).select("mail_id", "subject")


@query(
    """SELECT claim_id, artifact_hash, text, source_url, model, attestations, created_at, batch_no FROM claims"""
)
def schema_migration(s, d):
    """A snapshot of an older form, brought to the schema: columns of its own are kept behind."""
    return schemas.migrate(table(s, d, "claims").drop("quote"), "claims")


# Providers, notes and reports.


@query("SELECT doc_id AS item_id, list_transform(range(8), lambda i: round(CAST(CAST(CAST(('0x' || substr(sha256(text), CAST(2 * i + 1 AS INT), 2)) AS INT) / CAST(255 AS DOUBLE) AS FLOAT) AS DOUBLE), 6)) AS embedding FROM documents WHERE text IS NOT NULL")
def embed_texts(s, d):
    rows = providers.embed(table(s, d, "documents").select("doc_id", "text"), providers.LineProvider(), id_="doc_id")
    return rows.select("item_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


class Strict(providers.LineProvider):
    """Refuses texts in other languages than English: for rows that fail."""

    def complete(self, text: str, model: str) -> providers.Completion:
        if model == "refused":
            raise ValueError("not in English")
        return super().complete(text, model)


@query("SELECT doc_id, lang IS NULL OR lang <> 'en' AS failed, CASE WHEN lang = 'en' THEN NULL ELSE 'ValueError: not in English' END AS error, CASE WHEN lang = 'en' THEN 'done' ELSE 'ready' END AS status FROM documents WHERE text IS NOT NULL")
def provider_failures(s, d):
    """A failing call is a value of its row: the others go on, the job is ready again."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text", F.when(F.col("lang") == "en", "m").otherwise("refused").alias("model"))
    out = providers.complete(docs, Strict())
    return out.select("doc_id", F.col("error").isNotNull().alias("failed"), "error", F.when(F.col("error").isNull(), "done").otherwise("ready").alias("status"))


@query(
    """SELECT lower(trim(name)) AS name, string_agg('- `' || entity_id[1:12] || '` (—) [' || strftime(created_at, '%Y-%m-%d') || ']', chr(10) ORDER BY created_at, entity_id) AS body FROM entities WHERE trim(name) <> '' AND created_at IS NOT NULL GROUP BY 1"""
)
def mention_bodies(s, d):
    e = table(s, d, "entities").where("trim(name) <> '' and created_at is not null").select(F.lower(F.trim("name")).alias("name"), "created_at", "entity_id")
    line = notes.mention_line(F.struct(F.col("entity_id").alias("source_hash"), F.lit(None).cast("string").alias("source_url"), F.date_format("created_at", "yyyy-MM-dd").alias("date")))
    lines = F.array_sort(F.collect_list(F.struct("created_at", "entity_id", line.alias("line"))))
    return e.groupBy("name").agg(F.array_join(lines["line"], "\n").alias("body"))


@query("SELECT index, '| ' || index || ' | lines | ' || model || ' | ' || outputs || ' | ' || tokens_in || '/' || tokens_in || ' |' AS line FROM (SELECT CAST(doc_id % 5 AS INT) AS index, 'm' || doc_id % 5 AS model, count(*) AS outputs, CAST(sum(n_chars) AS BIGINT) AS tokens_in FROM documents GROUP BY 1, 2)")
def report_lines(s, d):
    g = table(s, d, "documents").groupBy((F.col("doc_id") % 5).cast("int").alias("index")).agg(F.count(F.lit(1)).alias("outputs"), F.sum("n_chars").alias("tokens_in"))
    return compare.report_table(g.withColumn("provider", F.lit("lines")).withColumn("model", F.concat(F.lit("m"), "index")).withColumn("tokens_out", F.col("tokens_in"))).select("index", "line")


@query(f"WITH {REG} SELECT artifact_hash, 'source' AS type, 'derived' AS authority, reg.source_type FROM reg WHERE created_at IS NOT NULL")
def frontmatters(s, d):
    meta = notes.source_note(F.col("artifact_hash"), F.col("created_at"), "1", F.col("source_type"), F.lit(None).cast("string"))
    rows = registry(s, d).where("created_at is not null").select("artifact_hash", meta.alias("meta"))
    return rows.select("artifact_hash", "meta.type", "meta.authority", "meta.source_type")


#: What is run for each stage, by its name.
HANDLERS = {"source_note": frontmatters, "dedup": dedup_stage, "entities": entity_stage}


@query(f"WITH {REG} SELECT 'source_note' AS stage, count(*) AS n FROM reg WHERE created_at IS NOT NULL UNION ALL SELECT 'dedup', count(DISTINCT claim_id) FROM claims WHERE text IS NOT NULL UNION ALL SELECT 'entities', count(*) FROM entities WHERE trim(name) <> ''")
def handler_runs(s, d):
    out = None
    for stage, handler in HANDLERS.items():
        n = handler(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    return out
