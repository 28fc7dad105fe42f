"""Notes: frontmatter as structs, bodies as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.schemas import AUTHORITIES, ENTITY_TYPES, NOTE_TYPES

# What notes consist of, the wording of their bodies and the sign for what is not known.
NONE = "—"


def frontmatter(note_type: str, authority: str, source_hash: Column, as_of: Column, pipeline_version: str, **more: Column) -> Column:
    """What every note records of how it came to be; ``more`` are further fields of its type, in the order given."""
    if note_type not in NOTE_TYPES:
        raise ValueError(f"invalid note type {note_type!r}; expected one of {sorted(NOTE_TYPES)}")
    if authority not in AUTHORITIES:
        raise ValueError(f"invalid authority {authority!r}; expected one of {sorted(AUTHORITIES)}")
    null = F.lit(None).cast("string")
    shared = {"source_url": null, "attribution_mode": null, "prompt_version": null, "provider": null, "model": null, "params": F.lit(None).cast("map<string,string>")}
    fields = {"type": F.lit(note_type), "authority": F.lit(authority), "source_hash": source_hash} | shared
    fields |= {"pipeline_version": F.lit(pipeline_version), "derived_at": as_of.cast("date"), "locked": F.lit(False)} | more
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def source_note(source_hash: Column, as_of: Column, pipeline_version: str, source_type: Column, url: Column, added: Column | None = None, matched: Column | None = None) -> Column:
    """Frontmatter of a source note, with how many claims it added and matched, 0 before that is known."""
    n = lambda c: F.lit(0) if c is None else c
    return frontmatter("source", "derived", source_hash, as_of, pipeline_version, source_type=source_type, claims_added=n(added), claims_matched=n(matched)).withField("source_url", url)


def entity_note(name: Column, entity_type: Column, source_hash: Column, as_of: Column, pipeline_version: str, mentions: Column) -> Column:
    """Frontmatter of an entity note with its mentions; a type that is not of the vocabulary fails."""
    kind = F.when(entity_type.isin(*ENTITY_TYPES), entity_type).otherwise(F.raise_error(F.concat(F.lit("invalid entity type "), entity_type)).cast("string"))
    return frontmatter("entity", "derived", source_hash, as_of, pipeline_version, name=name, entity_type=kind, mentions=mentions)


def source_body(source_id: Column, digest: Column, source_type: Column, fetched_at: Column, url: Column) -> Column:
    return F.concat(
        F.lit("# "), source_id, F.lit("\n\n> Source note for artifact `"), F.substring(digest, 1, 12), F.lit("` ("), source_type, F.lit(").\n\n- Raw manifest: `"), digest,
        F.lit("`\n- Fetched: "), fetched_at, F.lit("\n- Source URL: "), F.coalesce(F.nullif(url, F.lit("")), F.lit(NONE)), F.lit("\n"),
    )


def commentary_body(note: Column, target: Column, text: Column) -> Column:
    link = F.when(F.nullif(target, F.lit("")).isNotNull(), F.concat(F.lit("\n\nAnnotates: `"), F.substring(target, 1, 12), F.lit("`\n"))).otherwise("\n")
    return F.concat(F.lit("# Commentary "), note, F.lit("\n"), link, F.lit("\n---\n\n"), text, F.lit("\n"))


def attestation_line(a: Column) -> Column:
    """Of a struct of source_hash, source_url, date, quote."""
    return F.concat(
        F.lit("- `"), F.substring(a["source_hash"], 1, 12), F.lit("` ("), F.coalesce(F.nullif(a["source_url"], F.lit("")), F.lit(NONE)), F.lit(') — "'),
        F.coalesce(a["quote"], F.lit("")), F.lit('" ['), F.coalesce(a["date"], F.lit("")), F.lit("]"),
    )


def mention_line(m: Column) -> Column:
    """Of a struct of source_hash, source_url, date."""
    return F.concat(F.lit("- `"), F.substring(m["source_hash"], 1, 12), F.lit("` ("), F.coalesce(F.nullif(m["source_url"], F.lit("")), F.lit(NONE)), F.lit(") ["), F.coalesce(m["date"], F.lit("")), F.lit("]"))


def section(heading: Column, title: str, lines: Column) -> Column:
    """A heading and one section of lines, made again from all facts each time."""
    return F.concat(F.lit("# "), heading, F.lit(f"\n\n## {title}\n\n"), F.concat_ws("\n", lines), F.lit("\n"))
