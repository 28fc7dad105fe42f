"""The registered queries of the engine's own operators and, for each that SQL can tell, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import answers, keys, notes
from siltwork.functions import text as T
from siltwork.functions import vectors as V
from siltwork.operators import backlog as B
from siltwork.operators import compare, facts, providers, similarity
from siltwork.operators.merge import Snapshots, latest
from siltwork.session import cut, table
from siltwork.sources.mail import messages_to_artifacts
from siltwork.streaming import ingest, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STAGES = ("source_note", "extract_claims", "dedup", "entities")
STATES = ("ready", "running", "held", "done", "failed")
AS_OF = "2024-02-15 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Views shared by the queries: the registry, documents with it, and jobs and costs told from the event stream.


def registry(s: SparkSession, d: str) -> DataFrame:
    return B.register(table(s, d, "artifacts"))


def backlog_rows(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("artifact_hash", F.col("doc_id").alias("artifact_id"), F.col("created_at").alias("at"))
    return docs.join(registry(s, d), "artifact_hash").select("artifact_id", "artifact_hash", "source_type", "author", "source", "media", "title", "word_count", F.col("at").alias("created_at"))


def events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def jobs(s: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", "ready").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "done").when(F.col("event_type") == "purchase", "held").otherwise("failed")
    e = events(s, d).select(
        (F.col("user_id") * 30 + F.dayofmonth("ts") - 1).alias("artifact_id"), F.element_at(F.array(*map(F.lit, STAGES)), F.col("k") % 4 + 1).alias("stage"),
        state.alias("status"), F.col("ts").alias("updated_at"), "event_id",
    )
    return latest(e, ["artifact_id", "stage"], F.col("updated_at").desc(), F.col("event_id").desc()).drop("event_id")


REG = """reg AS (SELECT * EXCLUDE (rn, created_at, first_at), first_at AS created_at FROM (
  SELECT *, min(created_at) OVER (PARTITION BY artifact_hash) AS first_at,
    row_number() OVER (PARTITION BY artifact_hash ORDER BY created_at DESC NULLS LAST, source_type DESC NULLS LAST, author DESC NULLS LAST,
      source DESC NULLS LAST, media DESC NULLS LAST, title DESC NULLS LAST, word_count DESC NULLS LAST) AS rn FROM artifacts) WHERE rn = 1)"""
ROWS = REG + """, backlog AS (SELECT doc_id AS artifact_id, artifact_hash, reg.source_type, author, reg.source, media, title, word_count, documents.created_at
  FROM documents JOIN reg USING (artifact_hash))"""
JOBS = """ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
jobs AS (SELECT artifact_id, stage, status, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY artifact_id, stage ORDER BY updated_at DESC, event_id DESC) AS rn FROM (
    SELECT user_id * 30 + day(ts) - 1 AS artifact_id, ['source_note', 'extract_claims', 'dedup', 'entities'][k % 4 + 1] AS stage,
      CASE event_type WHEN 'signup' THEN 'ready' WHEN 'view' THEN 'running' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'held' ELSE 'failed' END AS status,
      ts AS updated_at, event_id FROM ev)) WHERE rn = 1)"""
STATUS = """state AS (SELECT artifact_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running'
  WHEN bool_or(status = 'held') THEN 'held' WHEN bool_or(status = 'ready') THEN 'ready' ELSE 'done' END AS current_status FROM jobs GROUP BY 1)"""
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


# Ingestion and text.


@query(f"WITH {REG} SELECT * FROM reg")
def registry_upsert(s, d):
    return registry(s, d)


@query(
    """SELECT h AS artifact_hash, doc_id, source, 'sha256/' || h[1:2] || '/' || h[3:4] || '/' || h || '/artifact.md' AS raw_key, copies FROM (
  SELECT sha256(text) AS h, doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY created_at DESC, doc_id DESC) AS rn,
    count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents WHERE text <> '') WHERE rn = 1"""
)
def content_addressed(s, d):
    docs = table(s, d, "documents").where("text <> ''").select(T.content_hash(F.col("text")).alias("artifact_hash"), "doc_id", "source", "created_at")
    newest = docs.groupBy("artifact_hash").agg(F.max(F.struct("created_at", "doc_id", "source")).alias("m"), F.count(F.lit(1)).alias("copies"))
    return newest.select("artifact_hash", "m.doc_id", "m.source", T.raw_key(F.col("artifact_hash"), "artifact.md").alias("raw_key"), "copies")


@query(
    f"""SELECT doc_id, substring(first, 1, 120) AS title, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS INT) AS words
FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')[1] AS first FROM documents)"""
)
def title_wordcount(s, d):
    return table(s, d, "documents").select("doc_id", T.title(F.col("text")).alias("title"), T.word_count(F.col("text")).alias("words"))


_PATTERNS = [p.replace("(?imd)", "(?im)") for p in (T.VIEW_ON_WEB, T.REDIRECT, T.UNSUBSCRIBE)]
_CLEAN = "text"
for _p in _PATTERNS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"
_CLEAN = STRIP.format(f"regexp_replace(regexp_replace({_CLEAN}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, nullif(regexp_extract(text, '{T.CANONICAL}', 1), '') AS canonical_url, {_CLEAN} AS clean FROM documents")
def newsletter_clean(s, d):
    return table(s, d, "documents").select("doc_id", T.canonical_url(F.col("text")).alias("canonical_url"), T.without_boilerplate(F.col("text")).alias("clean"))


_HTML = "html"
for _a, _b in (
    (r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", ""), (r"(?i)</?(?:p|div|br|li|tr|h[1-6]|blockquote|hr)\b[^>]*>", "\n"), (r"<[^>]*>", ""), ("&nbsp;", " "),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), (r"[ \t]+", " "), (r" ?\n[ \n]*", "\n"),
):
    _b = "chr(10)" if _b == "\n" else f"'{_b}'"
    _HTML = f"regexp_replace({_HTML}, '{_a}', {_b}, 'g')"
_BODY = f"coalesce(nullif({STRIP.format('text')}, ''), {STRIP.format(_HTML)}, '')"


@query(f"SELECT mail_id, {_BODY} AS body FROM mail_messages")
def mail_body(s, d):
    return table(s, d, "mail_messages").select("mail_id", T.body(F.col("text"), F.col("html")).alias("body"))


@query(
    f"""WITH b AS (SELECT *, {_BODY} AS raw FROM mail_messages), c AS (SELECT * EXCLUDE (text), raw AS text FROM b),
n AS (SELECT *, {_CLEAN} AS clean FROM c)
SELECT sha256(clean) AS artifact_hash, 'email' AS source_type, from_ AS author, coalesce(nullif(headers['list-id'][1], ''), from_) AS source, 'text' AS media,
  subject AS title, CAST(len(list_filter(string_split_regex(clean, '\\s+'), lambda w: w <> '')) AS INT) AS word_count,
  coalesce(nullif(regexp_extract(raw, '{T.CANONICAL}', 1), ''), headers['message-id'][1]) AS source_url, headers['message-id'][1] AS message_id,
  headers['list-id'][1] AS list_id, nullif(regexp_extract(raw, '{T.CANONICAL}', 1), '') AS canonical_url, clean AS text FROM n WHERE clean <> ''"""
)
def mail_artifacts(s, d):
    return messages_to_artifacts(table(s, d, "mail_messages"))


@query(
    f"""WITH x AS (SELECT artifact_hash, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(i AS INT) AS ordinal, 'claim-' || artifact_hash[1:8] || '-' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS claim_id, c AS text
FROM (SELECT artifact_hash, doc_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS i FROM x)"""
)
def claim_candidates(s, d):
    rows = table(s, d, "documents").select("doc_id", "artifact_hash", F.posexplode(T.lines(F.col("text"))).alias("ordinal", "text"))
    return rows.select("doc_id", "ordinal", keys.claim_id(F.col("artifact_hash"), F.col("ordinal")).alias("claim_id"), "text")


def _answers(s, d):
    """Claims as answers of a model, in the shapes in which such answers come."""
    c = table(s, d, "claims").where("text is not null").select("claim_id", "text", "quote", "batch_no", "attestations").distinct()
    one = F.to_json(F.struct(F.col("text").alias("claim"), F.col("quote")))
    shapes = (
        F.concat(F.lit("["), one, F.lit("]")), F.concat(F.lit("Here you are:\n```json\n["), one, F.lit("]\n```")), F.concat(F.lit('{"claims": ['), one, F.lit("]}")),
        F.concat(F.lit("```JSON\n["), F.to_json(F.struct(F.col("text").alias("text"))), F.lit(', {"claim": "  "}]\n```')), F.lit("no claims, sorry"),
    )
    pick = F.length("text") % len(shapes)
    return c.withColumn("shape", pick).withColumn("answer", F.element_at(F.array(*shapes), pick + 1))


@query(
    f"""SELECT DISTINCT claim_id, batch_no, attestations, CAST(length(text) % 5 AS INT) AS shape, {STRIP.format('text')} AS text,
  CASE WHEN length(text) % 5 = 3 OR quote IS NULL THEN '' ELSE {STRIP.format('quote')} END AS quote FROM claims WHERE length(text) % 5 <> 4"""
)
def answers_claims(s, d):
    rows = _answers(s, d).select("claim_id", "batch_no", "attestations", "shape", F.explode(answers.claims_of("answer")).alias("c"))
    return rows.select("claim_id", "batch_no", "attestations", "shape", T.strip(F.col("c.text")).alias("text"), T.strip(F.col("c.quote")).alias("quote"))


@query(
    f"""SELECT entity_id, {STRIP.format('name')} AS name, CASE WHEN lower({STRIP.format("coalesce(entity_type, '')")}) IN ('person', 'tool', 'company', 'show') THEN lower({STRIP.format('entity_type')}) ELSE 'other' END AS type
FROM entities WHERE {STRIP.format('name')} <> ''"""
)
def answers_entities(s, d):
    e = table(s, d, "entities")
    answer = F.concat(F.lit('Sure: {"entities": ['), F.to_json(F.struct("name", F.col("entity_type").alias("type"))), F.lit("]} done"))
    rows = e.withColumn("answer", answer).select("entity_id", F.explode(answers.entities_of("answer")).alias("e"))
    return rows.select("entity_id", T.strip(F.col("e.name")).alias("name"), F.col("e.type").alias("type"))


@query("SELECT claim_id, batch_no, max(attestations) AS attestations, bool_or(batch_no % 4 = 1) AS same FROM claims GROUP BY 1, 2")
def answers_verdicts(s, d):
    shapes = ('{"same": false}', 'I think ```json {"same": true} ```', "yes", '["same"]')
    answer = F.element_at(F.array(*map(F.lit, shapes)), F.col("batch_no") % 4 + 1)
    c = table(s, d, "claims").groupBy("claim_id", "batch_no").agg(F.max("attestations").alias("attestations"))
    return c.select("claim_id", "batch_no", "attestations", answers.same_of(answer).alias("same"))


# Backlog analytics.


@query(f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY 1")
def status_counts(s, d):
    return jobs(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {JOBS} SELECT stage, CAST(list_position(['source_note', 'extract_claims', 'dedup', 'entities'], stage) AS INT) AS ord,
  {', '.join(f"count(*) FILTER (status = '{x}') AS {x}" for x in STATES)} FROM jobs GROUP BY 1"""
)
def stage_matrix(s, d):
    return B.stage_matrix(jobs(s, d), STAGES, STATES)


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 6) AS usd, round(avg(CAST(json_extract(props, '$.k') AS INT)), 6) AS latency_ms FROM events GROUP BY 1")
def cost_summary(s, d):
    return B.cost_summary(events(s, d).select(F.col("event_type").alias("stage"), F.col("value").alias("usd"), F.col("k").alias("latency_ms")))


@query(f"WITH {JOBS}, {STATUS} SELECT * FROM state")
def current_status(s, d):
    return B.current_status(jobs(s, d), "artifact_id")


@query(
    f"""WITH {JOBS}, p AS (SELECT *, list_position(['source_note', 'extract_claims', 'dedup', 'entities'], stage) AS o FROM jobs)
SELECT artifact_id, count(*) FILTER (status = 'done') AS done, count(*) AS total, arg_min(stage, o) FILTER (status <> 'done') AS stage,
  arg_min(status, o) FILTER (status <> 'done') AS status FROM p GROUP BY 1"""
)
def frontier(s, d):
    return B.frontier(jobs(s, d), STAGES, "artifact_id")


@query(
    f"""WITH {JOBS}, c AS (SELECT unnest(['source_note', 'extract_claims', 'dedup', 'entities']) AS stage, unnest([0, 1, 2, 3]) AS ord)
SELECT a.artifact_id, CAST(ord AS INT) AS ord, c.stage, status, updated_at FROM (SELECT DISTINCT artifact_id FROM jobs) a CROSS JOIN c LEFT JOIN jobs USING (artifact_id, stage)"""
)
def timeline(s, d):
    j = jobs(s, d)
    return B.timeline(j, j, STAGES, "artifact_id")


@query("SELECT * FROM (VALUES ('default', 'source_note', 'extract_claims'), ('default', 'extract_claims', 'dedup'), ('default', 'dedup', 'entities'), ('default', 'entities', NULL), ('personal_note', 'personal', NULL)) t(source_type, stage, next_stage)")
def next_stages(s, d):
    return B.next_stages(s, {"default": STAGES, "personal_note": ("personal",)})


@query(f"WITH {ROWS} SELECT * FROM backlog ORDER BY created_at DESC, artifact_id LIMIT 50")
def backlog_page(s, d):
    return B.page(backlog_rows(s, d), key="artifact_id")


@query(f"WITH {ROWS}, {JOBS}, {STATUS} SELECT backlog.*, current_status FROM backlog JOIN state USING (artifact_id) WHERE backlog.source_type = 'email' AND current_status <> 'done'")
def backlog_open(s, d):
    return B.backlog(backlog_rows(s, d), jobs(s, d), {"source_type": "email", "hide_completed": True, "author": ""}, "artifact_id")


@query(f"WITH {ROWS} SELECT * FROM backlog WHERE contains(lower(title), 'ledger') OR contains(lower(author), 'ledger') OR contains(lower(source), 'ledger')")
def backlog_search(s, d):
    return B.backlog(backlog_rows(s, d), None, {"search": "Ledger"}, "artifact_id")


@query(f"WITH {ROWS}, {JOBS}, {STATUS} SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 50.0) AS BIGINT), 1) AS pages FROM backlog JOIN state USING (artifact_id) WHERE current_status = 'failed'")
def backlog_count(s, d):
    return B.pages(B.backlog(backlog_rows(s, d), jobs(s, d), {"status": "failed"}, "artifact_id"))


@query(" UNION ".join(f"SELECT '{f}' AS facet, {f} AS value FROM artifacts WHERE {f} IS NOT NULL" for f in B.FACETS))
def facets(s, d):
    return B.facet_values(table(s, d, "artifacts"))


@query(f"WITH {JOBS} SELECT DISTINCT artifact_id FROM jobs WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = artifact_id)")
def unregistered(s, d):
    return B.unregistered(jobs(s, d), table(s, d, "documents").select(F.col("doc_id").alias("artifact_id")), "artifact_id")


@query(
    """WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY fetched_at DESC NULLS LAST, source_url DESC NULLS LAST) AS rn FROM manifest) WHERE rn = 1),
k AS (SELECT DISTINCT content_hash AS artifact_hash FROM manifest WHERE content_hash IS NOT NULL AND content_hash NOT IN (SELECT artifact_hash FROM artifacts WHERE author IS NOT NULL AND artifact_hash IS NOT NULL))
SELECT artifact_hash, source_type, extra['from'] AS author, coalesce(nullif(extra['list_id'], ''), nullif(source_url, '')) AS source, 'text' AS media,
  coalesce(nullif(extra['subject'], ''), nullif(source_url, '')) AS title FROM k JOIN m ON content_hash = artifact_hash"""
)
def backfill(s, d):
    m = table(s, d, "manifest")
    known = table(s, d, "artifacts").where("author is not null and artifact_hash is not null")
    return B.backfill(B.unregistered(m.select(F.col("content_hash").alias("artifact_hash")), known), m)


@query(
    """WITH h AS (SELECT DISTINCT artifact_hash AS h FROM artifacts), r AS (SELECT DISTINCT upper(h[1:n]) AS ref FROM h, (VALUES (2), (3), (4), (8)) v(n))
SELECT ref, min(h) AS artifact_hash FROM r JOIN h ON starts_with(h, lower(ref)) GROUP BY ref HAVING count(*) = 1"""
)
def prefix_resolve(s, d):
    a = table(s, d, "artifacts").select("artifact_hash").distinct()
    refs = a.select(F.explode(F.array(*(F.upper(F.substring("artifact_hash", 1, n)) for n in (2, 3, 4, 8)))).alias("ref")).distinct()
    return B.resolve_prefixes(refs, a)


@query(f"WITH {JOBS} SELECT * FROM jobs WHERE status = 'running' AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE")
def stale_running(s, d):
    return B.stale(jobs(s, d), F.lit(AS_OF).cast("timestamp_ntz"))


_OVERRIDES = [("global", "*", "paused"), ("stage", "dedup", "running"), ("source_type", "web", "running"), ("source_type", "", "paused"), ("artifact", "7", "paused"), ("artifact", "31", "running")]


@query(
    f"""WITH {JOBS}, c AS (SELECT * FROM (VALUES {', '.join(map(str, _OVERRIDES))}) t(scope, key, state))
SELECT jobs.artifact_id, stage, coalesce((SELECT state FROM c WHERE scope = 'artifact' AND key = CAST(jobs.artifact_id AS VARCHAR)), (SELECT state FROM c WHERE scope = 'source_type' AND key = coalesce(documents.source_type, '')),
  (SELECT state FROM c WHERE scope = 'stage' AND key = stage), (SELECT state FROM c WHERE scope = 'global' AND key = '*'), 'running') AS state FROM jobs LEFT JOIN documents ON doc_id = artifact_id"""
)
def override_effective(s, d):
    c = s.createDataFrame(_OVERRIDES, "scope string, key string, state string")
    kinds = table(s, d, "documents").select(F.col("doc_id").alias("artifact_id"), "source_type")
    rows = jobs(s, d).join(kinds, "artifact_id", "left").select("artifact_id", "stage", "source_type")
    scopes = {"artifact": F.col("artifact_id").cast("string"), "source_type": F.col("source_type"), "stage": F.col("stage"), "global": F.lit("*")}
    return B.first_override(rows, c, scopes, "running").drop("source_type")


@query(
    f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY updated_at, artifact_id) AS n FROM jobs WHERE status = 'ready')
SELECT artifact_id, stage, status, updated_at FROM r WHERE n <= CASE stage WHEN 'dedup' THEN 20 WHEN 'entities' THEN 5 ELSE 1000000000 END"""
)
def limited_ready(s, d):
    limits = s.createDataFrame([("dedup", 20), ("entities", 5)], "stage string, batch_limit int")
    rows = B.first_of_each(jobs(s, d).where("status = 'ready'"), limits, "stage", F.col("updated_at"), F.col("artifact_id"))
    return rows.select("artifact_id", "stage", "status", "updated_at")


# Similarity, claims, entities.

_KNN = """WITH p AS (SELECT a.vec_id AS query, b.vec_id AS item, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, item) AS rank FROM p{}) SELECT query, item, distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""


@query(_KNN.format(""))
def knn_topk(s, d):
    e = table(s, d, "embeddings")
    return similarity.knn(e.where("vec_id % 100 = 0"), e, 5, None, "vec_id")


@query(_KNN.format(" WHERE distance <= 1.2"))
def knn_threshold(s, d):
    e = table(s, d, "embeddings")
    return similarity.knn(e.where("vec_id % 100 = 0"), e, 5, 1.2, "vec_id")


@query("SELECT item_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / CASE WHEN n = 0 THEN 1 ELSE n END, 6)) AS embedding FROM (SELECT item_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)")
def vectors_normalised(s, d):
    v = table(s, d, "vectors").where(F.size("embedding") == 64).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return v.select("item_id", F.transform(V.normalised(F.col("embedding")), lambda x: F.round(x, 6)).alias("embedding"))


def _said(c):
    return F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", " "))


_ATTEST = """k AS (SELECT claim_id AS id, artifact_hash, batch_no, lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS said, created_at FROM claims WHERE text IS NOT NULL),
f AS (SELECT said, arg_min(id, (batch_no, created_at, id)) AS claim FROM k GROUP BY 1), t AS (SELECT k.*, claim, id = claim AS is_new FROM k JOIN f USING (said))"""


def attested(s, d):
    rows = table(s, d, "claims").where("text is not null").select(F.col("claim_id").alias("id"), "artifact_hash", "batch_no", _said(F.col("text")).alias("said"), "created_at")
    return facts.attest(rows, F.col("said"), F.col("batch_no"), F.col("created_at"))


@query(f"WITH {_ATTEST} SELECT id, artifact_hash, batch_no, claim, is_new FROM t")
def dedup_attest(s, d):
    return attested(s, d).select("id", "artifact_hash", "batch_no", "claim", "is_new")


@query(f"WITH {_ATTEST} SELECT claim, count(*) AS attestations, count(DISTINCT artifact_hash) AS sources FROM t GROUP BY 1")
def attestation_counts(s, d):
    return facts.attestation_counts(attested(s, d), F.col("artifact_hash"))


@query(f"WITH {_ATTEST} SELECT batch_no, count(*) FILTER (is_new) AS new, count(*) FILTER (NOT is_new) AS attested FROM t GROUP BY 1")
def attestation_runs(s, d):
    return facts.run_summary(attested(s, d), "batch_no")


@query(
    f"""WITH {_ATTEST} SELECT claim, string_agg('- `' || coalesce(artifact_hash[1:12], '') || '` (—) — "' || said || '" [' || strftime(created_at, '%Y-%m-%d') || ']', chr(10) ORDER BY created_at, id, artifact_hash NULLS FIRST) AS body, count(*) AS n FROM t GROUP BY 1"""
)
def attestation_bodies(s, d):
    rows = attested(s, d).select("claim", "created_at", "id", "artifact_hash", "said")
    listed = facts.accumulate(rows, "claim", ["created_at", "artifact_hash", "said"], "created_at", "id", "artifact_hash")
    line = lambda x: notes.attestation_line(
        F.struct(F.coalesce(x["artifact_hash"], F.lit("")).alias("source_hash"), F.lit(None).cast("string").alias("source_url"), F.date_format(x["created_at"], "yyyy-MM-dd").alias("date"), x["said"].alias("quote"))
    )
    return listed.select("claim", F.concat_ws("\n", F.transform("items", line)).alias("body"), "n")


@query("SELECT source, count(DISTINCT author) AS authors, count(DISTINCT artifact_hash) AS artifacts FROM artifacts WHERE source IS NOT NULL GROUP BY 1")
def corroboration(s, d):
    return table(s, d, "artifacts").where("source is not null").groupBy("source").agg(F.count_distinct("author").alias("authors"), F.count_distinct("artifact_hash").alias("artifacts"))


@query(
    """SELECT p_name AS name, p_type AS type, min(p_partkey) AS first, count(*) AS mentions FROM part GROUP BY 1, 2"""
)
def entity_exact(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), "p_partkey")
    return facts.exact_entities(p, "p_partkey").withColumn("first", F.col("first.p_partkey"))


@query(
    """WITH e AS (SELECT p_name AS name, p_type AS type, min(p_partkey) AS first FROM part GROUP BY 1, 2),
g AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'entity') AS slug FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY first) AS n FROM g)
SELECT name, type, first, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS entity_id FROM r"""
)
def entity_slugs(s, d):
    return facts.entity_ids(entity_exact(s, d).select("name", "type", "first"), "first")


def leader_clusters(s, d):
    """Vectors in order of their ids around leaders within 1.2; the links are all pairs of vectors that near."""
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    near = cut(similarity.within(v, 1.2, "vec_id"), "near")
    return similarity.leaders(v.select("vec_id", F.col("vec_id").alias("ord")), near, "vec_id")


QUERIES["leader_clusters"] = leader_clusters


# Notes, annotations, derivations, variants.


@query(
    """WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY fetched_at DESC NULLS LAST, source_url DESC NULLS LAST) AS rn FROM manifest) WHERE rn = 1)
SELECT source_type || '-' || content_hash[1:8] AS source_id, '# ' || source_type || '-' || content_hash[1:8] || chr(10) || chr(10) || '> Source note for artifact `' || content_hash[1:12] || '` (' || source_type || ').' || chr(10) || chr(10)
  || '- Raw manifest: `' || content_hash || '`' || chr(10) || '- Fetched: ' || fetched_at || chr(10) || '- Source URL: ' || coalesce(nullif(source_url, ''), '—') || chr(10) AS body FROM m"""
)
def source_notes(s, d):
    m = latest(table(s, d, "manifest"), ["content_hash"], F.col("fetched_at").desc_nulls_last(), F.col("source_url").desc_nulls_last())
    id_ = keys.note_id(F.col("source_type"), F.col("content_hash"))
    return m.select(id_.alias("source_id"), notes.source_body(id_, F.col("content_hash"), F.col("source_type"), F.col("fetched_at"), F.col("source_url")).alias("body"))


@query(
    f"""WITH {REG} SELECT content_hash, annotates, title AS target_title, reg.source_type AS target_type FROM (SELECT DISTINCT content_hash, annotates FROM manifest WHERE annotates IS NOT NULL) LEFT JOIN reg ON artifact_hash = annotates"""
)
def annotate_links(s, d):
    m = table(s, d, "manifest").select("content_hash", "annotates").distinct()
    return facts.annotations(m, registry(s, d)).select("content_hash", "annotates", "target_title", "target_type")


@query(
    """SELECT doc_id, 'personal-' || artifact_hash[1:8] AS note_id, '# Commentary personal-' || artifact_hash[1:8] || chr(10)
  || CASE WHEN a IS NULL THEN chr(10) ELSE chr(10) || chr(10) || 'Annotates: `' || a[1:12] || '`' || chr(10) END || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) AS body
FROM documents LEFT JOIN (SELECT content_hash, max(annotates) AS a FROM manifest GROUP BY 1) ON content_hash = artifact_hash WHERE source_type = 'personal_note' AND text IS NOT NULL"""
)
def personal_notes(s, d):
    target = table(s, d, "manifest").groupBy(F.col("content_hash").alias("artifact_hash")).agg(F.max("annotates").alias("a"))
    docs = table(s, d, "documents").where("source_type = 'personal_note' and text is not null").join(target, "artifact_hash", "left")
    id_ = keys.note_id("personal", F.col("artifact_hash"))
    return docs.select("doc_id", id_.alias("note_id"), notes.commentary_body(id_, F.col("a"), F.col("text")).alias("body"))


_VARIANTS = [(0, "lines", "one", "v1", {"top": "1", "a": "x"}), (1, "lines", "three", "v1", {"a": 'q"\\'}), (2, "lines", "five", "v2", {})]
_VARIANT_SQL = """v AS (SELECT * FROM (VALUES (0, 'lines', 'one', 'v1', '{"a":"x","top":"1"}', 1), (1, 'lines', 'three', 'v1', '{"a":"q\\"\\\\"}', 3), (2, 'lines', 'five', 'v2', '{}', 5)) t(index, provider, model, version, params, cap)),
n AS (SELECT doc_id, artifact_hash, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\f\\v]+|[ \\t\\r\\f\\v]+$', '', 'g')), lambda x: x <> '') AS l,
  CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INT) AS words FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, artifact_hash, index, provider, model, words, substr(sha256('{"input_hash":"' || artifact_hash || '","model":"' || model || '","params":' || params || ',"prompt_version":"' || version || '","provider":"' || provider || '"}'), 1, 12) AS gen_key,
  list_filter(l[1:cap], lambda x: NOT regexp_full_match(x, '[\\s\\p{Z}\\x{85}]*')) AS kept FROM n, v)"""


def variant_results(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "artifact_hash", "text")
    variants = s.createDataFrame(_VARIANTS, "index int, provider string, model string, prompt_version string, params map<string,string>")
    provider = providers.LineProvider(by_model={"one": 1, "three": 3, "five": 5})
    return compare.run(docs, variants, provider).withColumn("claims", answers.claims_of("answer")).withColumn("outputs", F.size("claims"))


@query(f"WITH {_VARIANT_SQL} SELECT doc_id, index, gen_key, CAST(len(kept) AS INT) AS outputs, words AS tokens_in FROM x")
def variants_run(s, d):
    return variant_results(s, d).select("doc_id", "index", "gen_key", "outputs", "tokens_in")


@query(f"WITH {_VARIANT_SQL} SELECT index, provider, model, count(*) AS inputs, CAST(sum(len(kept)) AS BIGINT) AS outputs, CAST(sum(words) AS BIGINT) AS tokens_in FROM x GROUP BY 1, 2, 3")
def variants_report(s, d):
    return compare.report(variant_results(s, d)).drop("tokens_out", "latency_ms")


@query(f"WITH {_VARIANT_SQL} SELECT doc_id, index, gen_key, CAST(len(kept) AS INT) AS outputs FROM x WHERE index = doc_id % 3")
def variants_approve(s, d):
    r = cut(variant_results(s, d).select("doc_id", "index", "gen_key", "outputs"), "variants")
    choices = r.select("doc_id").distinct().withColumn("index", (F.col("doc_id") % 3).cast("int"))
    return compare.approve(r, choices, "doc_id").select("doc_id", "index", "gen_key", "outputs")


# Streams.


@query(f"WITH {REG} SELECT artifact_hash, source_type, author, source, media, title, word_count, created_at FROM reg")
def stream_registry(s, d):
    a = table(s, d, "artifacts")
    order = ["created_at", "source_type", "author", "source", "media", "title", "word_count"]
    store = Snapshots(s, ingest.new_folder(s, "registry"), a.select("artifact_hash", *order, F.col("created_at").alias("latest_created_at")).schema)
    ingest.keep_latest(ingest.parquet_stream(s, d, "artifacts").select("artifact_hash", *order), store, ["artifact_hash"], order, ingest.new_folder(s, "registry-state"), ("created_at",))
    return store.read().drop("latest_created_at")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_hourly(s, d):
    return windows.hourly(s, d).withColumn("value", F.round("value", 4))
