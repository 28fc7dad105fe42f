"""Identifiers and generating keys."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def note_id(kind: Column | str, digest: Column) -> Column:
    """<kind>-<first 8 of the hash>."""
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("-"), F.substring(digest, 1, 8))


def claim_id(digest: Column, ordinal: Column) -> Column:
    """claim-<first 8 of the hash>-<at least two digits>, ordinals from 0."""
    digits = F.concat(F.when(ordinal < 10, "0").otherwise(""), ordinal.cast("string"))
    return F.concat(F.lit("claim-"), F.substring(digest, 1, 8), F.lit("-"), digits)


def key_digest(key: dict) -> str:
    """Digest of a generating key on the driver: 12 hex digits over its canonical JSON."""
    return hashlib.sha256(json.dumps(key, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def json_text(c: Column) -> Column:
    """A text as a JSON string as ``json.dumps`` writes it: quotes, backslashes and control characters escaped, everything
    beyond ASCII as UTF-16 units; null as null."""
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}

    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(x: Column) -> Column:
        # The code point, of the big-endian bytes of the character.
        n = F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("int")
        above = n - 0x10000
        pair = F.concat(unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(0x3FF) + 0xDC00))
        # The short forms come first.
        out = F.when(F.lit(False), F.lit(""))
        for code, text in short.items():
            out = out.when(n == code, F.lit(text))
        return out.when(n > 0xFFFF, pair).when((n < 32) | (n > 126), unit(n)).otherwise(x)

    full = F.array_join(F.transform(F.split(c, ""), escaped), "")
    plain = c.rlike(r'^[ !#-\[\]-~]*$')
    return F.coalesce(F.concat(F.lit('"'), F.when(plain, c).otherwise(full), F.lit('"')), F.lit("null"))


def key_digest_column(provider: Column, model: Column, params: Column, prompt_version: Column, input_hash: Column) -> Column:
    """Digest of a generating key in the plan; ``params`` is a map of texts, ordered by its keys."""
    entries = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"])))
    blob = F.concat(
        F.lit('{"input_hash":'), json_text(input_hash), F.lit(',"model":'), json_text(model), F.lit(',"params":{'), F.concat_ws(",", entries),
        F.lit('},"prompt_version":'), json_text(prompt_version), F.lit(',"provider":'), json_text(provider), F.lit("}"),
    )
    return F.substring(F.sha2(blob, 256), 1, 12)
