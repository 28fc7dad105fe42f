"""Reading what a model answered: JSON with prose or fences around it, as expressions over VARIANT; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions.text import strip
from siltwork.schemas import ENTITY_TYPES

#: Where in an answer its JSON can be: all of it, from the first bracket to the last, from the first brace to the last.
SPANS = (r"(?s)^(.*)$", r"(?s)(\[.*\])", r"(?s)(\{.*\})")


def value_of(answer: Column) -> Column:
    """The JSON value of an answer as a VARIANT: of the first span that is JSON; null if none is."""
    return F.coalesce(*(F.try_parse_json(F.regexp_extract(F.trim(answer), span, 1)) for span in SPANS))


def listed(value: Column, *names: str) -> Column:
    """The entries of a value that is a list, or that holds one under one of the names; else none."""
    kind = "array<variant>"
    return F.coalesce(*(F.try_variant_get(value, path, kind) for path in ("$", *(f"$.{n}" for n in names))), F.array().cast(kind))


def named_text(entry: Column, *names: str) -> Column:
    """The first of an entry's fields that holds a text which is not blank, stripped; null if none does."""
    field = lambda n: F.when(F.schema_of_variant(F.try_variant_get(entry, f"$.{n}", "variant")) == "STRING", F.try_variant_get(entry, f"$.{n}", "string"))
    return F.coalesce(*(F.nullif(strip(field(n)), F.lit("")) for n in names))


def bare_text(entry: Column) -> Column:
    """An entry that is itself a text, stripped; else null."""
    return F.when(F.schema_of_variant(entry) == "STRING", F.nullif(strip(F.try_variant_get(entry, "$", "string")), F.lit("")))


def claims_of(answer: Column | str) -> Column:
    """array<struct<text, quote>> of the claims in an answer; entries without a text are left out."""
    entries = listed(value_of(F.col(answer) if isinstance(answer, str) else answer), "claims", "items")
    read = lambda e: F.struct(F.coalesce(named_text(e, "claim", "text"), bare_text(e)).alias("text"), F.coalesce(named_text(e, "quote"), F.lit("")).alias("quote"))
    return F.filter(F.transform(entries, read), lambda c: c["text"].isNotNull())


def entities_of(answer: Column | str) -> Column:
    """array<struct<name, type>> of the entities in an answer; a type that is not of the vocabulary counts as 'other'."""
    entries = listed(value_of(F.col(answer) if isinstance(answer, str) else answer), "entities", "items")

    def read(e: Column) -> Column:
        kind = F.lower(named_text(e, "type", "entity_type"))
        return F.struct(F.coalesce(named_text(e, "name"), bare_text(e)).alias("name"), F.when(kind.isin(*ENTITY_TYPES), kind).otherwise("other").alias("type"))

    return F.filter(F.transform(entries, read), lambda c: c["name"].isNotNull())


def same_of(answer: Column | str) -> Column:
    """Does an answer say "same"? One that can't be read, or says neither true nor false, says no."""
    value = value_of(F.col(answer) if isinstance(answer, str) else answer)
    return F.coalesce(F.try_variant_get(value, "$.same", "boolean"), F.lit(False))
