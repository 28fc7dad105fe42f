"""Schemas of the engine's tables, and additive migration of older snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

_TABLES = {
    "jobs": "artifact_hash string, stage string, status string, attempts int, claimed_by string, error string, input_path string, output_path string, source_type string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "controls": "scope string, key string, state string, batch_limit int, note string, updated_at timestamp_ntz",
    "runs": "run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, stats_json string",
    "costs": "artifact_hash string, stage string, provider string, model string, tokens_in int, tokens_out int, usd double, latency_ms int, at timestamp_ntz",
    "claims": "claim_id string, artifact_hash string, text string, source_url string, model string, attestations int, created_at timestamp_ntz",
    "entities": "entity_id string, name string, entity_type string, mentions int, created_at timestamp_ntz",
    "artifacts": "artifact_hash string, source_type string, author string, source string, media string, title string, word_count int, created_at timestamp_ntz",
    "vectors": "item_id string, embedding array<float>",
    "manifest": "content_hash string, source_type string, source_url string, fetched_at string, ingestor_version string, ext string, annotates string, extra map<string,string>",
    "mail": "text string, html string, from_ string, subject string, date string, headers map<string,array<string>>",
}

#: Closed vocabularies of notes and entities (fixed values).
NOTE_TYPES = ("source", "claim", "entity", "hub", "relation", "commentary")
AUTHORITIES = ("derived", "personal")
ENTITY_TYPES = ("person", "tool", "company", "show", "other")


def schema(name: str) -> StructType:
    return _parse_datatype_string(_TABLES[name])


def migrate(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of the table's schema: missing ones null, unknown ones kept at the end."""
    want = schema(name)
    empty = df.sparkSession.createDataFrame([], want)
    out = empty.unionByName(df, allowMissingColumns=True)
    return out.select(*want.fieldNames(), *(c for c in out.columns if c not in want.fieldNames()))
