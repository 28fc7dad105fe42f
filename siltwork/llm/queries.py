"""Queries of the training-data operators, each over whole tables with production parameters, and SQL where it can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltwork.llm import claimindex, linetemplates, mailbody, mixing, names, nearest, residue, tokens
from siltwork.session import cut, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return mailbody.not_new(table(spark, folder, "mail_messages"))


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    mails = table(spark, folder, "mail_messages")
    return mailbody.new_text(mails, mailbody.not_new(mails))


def _lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    return docs, linetemplates.repeated_lines(docs, table(spark, folder, "artifacts"), table(spark, folder, "manifest"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder)[1]


def p2_text(spark: SparkSession, folder: str) -> DataFrame:
    docs, lines = _lines(spark, folder)
    return linetemplates.without_lines(docs.select("doc_id", "text"), lines)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return claimindex.repeats(table(spark, folder, "claims"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variants(table(spark, folder, "entities"), table(spark, folder, "artifacts"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.pairs(table(spark, folder, "vectors"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents"), table(spark, folder, "artifacts"), table(spark, folder, "manifest"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return residue.without_residue(docs, cut(p8_found(spark, folder), "residue"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_text, p2_found, p2_text, p3_found, p4_found, p5_found, p6_ids, p7_mix, p7_shares, p8_found, p8_kept)
}

_EXCESSIVE = r"""
WITH a AS (SELECT artifact_hash AS h, min(source) AS s FROM artifacts GROUP BY 1),
m AS (SELECT content_hash AS h, min(extra['list_id']) AS l, min(extra['site']) AS s FROM manifest GROUP BY 1),
d AS (SELECT doc_id, text, coalesce(documents.source, a.s, m.l, m.s) AS src FROM documents
      LEFT JOIN a ON a.h = artifact_hash LEFT JOIN m ON m.h = artifact_hash),
t AS (SELECT src, count(*) AS total FROM d GROUP BY 1),
x AS (SELECT doc_id, src, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
k AS (SELECT doc_id, src, line, CAST(line_no AS INT) AS line_no, lower(regexp_replace(line, '[^\p{L}]', '', 'g')) AS key FROM x),
b AS (SELECT src, key FROM k JOIN t USING (src) WHERE key <> '' GROUP BY src, key
      HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.03 * any_value(total))
"""

SQL: dict[str, str] = {
    "p2_found": _EXCESSIVE + "SELECT doc_id, line_no FROM k JOIN b USING (src, key)",
    "p2_text": _EXCESSIVE
    + """, kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM k LEFT JOIN b USING (src, key) WHERE b.key IS NULL GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM d LEFT JOIN kept USING (doc_id)""",
    "p5_found": """
WITH u AS (SELECT item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM vectors
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.item_id AS a, b.item_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.item_id <> b.item_id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM s)
SELECT DISTINCT least(a, b) AS item_a, greatest(a, b) AS item_b FROM r WHERE place <= 5""",
}
