"""Instruction blocks of model requests, with the place each came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the result.
ROLES = ("system", "developer", "user")
UNKNOWN = "client_generated_or_unattributed"


def _text(v: Column) -> Column:
    """A variant's text if it is a string, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def instruction_blocks(requests: DataFrame, key: str, request: str, markers: dict[str, str], exact: dict[str, str] | None = None, root: str = "") -> DataFrame:
    """(key, location, role, bytes, sha256, normalized_sha256, origins): the instruction texts inside JSON requests.

    A request's ``instructions`` is a block, and so is each string content and each part with a text among the ``input`` items
    of system, developer and user; ``location`` is its JSON path.  ``markers`` gives an origin to texts that hold
    a string, ``exact`` to texts that equal one; others are unattributed.  In the normalized digest
    ``root`` reads ``<fixture>``.  Null and malformed requests, and values of other types, give no block.
    One pass without an exchange; a request is one row.
    """
    v = F.try_parse_json(request)
    block = lambda where, role, text: F.struct(where.alias("location"), role.alias("role"), text.alias("text"))
    own = F.array(block(F.lit("$.instructions"), F.lit("system"), _text(F.try_variant_get(v, "$.instructions", "variant"))))

    def of_item(item: Column, i: Column) -> Column:
        role = _text(F.try_variant_get(item, "$.role", "variant"))
        content = F.try_variant_get(item, "$.content", "variant")
        where = F.concat(F.lit("$.input["), i.cast("string"), F.lit("].content"))
        part = lambda p, j: block(F.concat(where, F.lit("["), j.cast("string"), F.lit("]")), role, _text(F.try_variant_get(p, "$.text", "variant")))
        parts = F.coalesce(F.transform(F.try_variant_get(content, "$", "array<variant>"), part), F.array(block(where, role, _text(content))))
        return F.when(role.isin(*ROLES), parts).otherwise(F.slice(parts, 1, 0))

    items = F.coalesce(F.flatten(F.transform(F.try_variant_get(v, "$.input", "array<variant>"), of_item)), F.slice(own, 1, 0))
    found = requests.select(key, F.inline(F.concat(own, items))).filter("text IS NOT NULL")
    text = F.col("text")
    named = [F.when(F.contains(text, F.lit(m)), F.lit(n)) for n, m in markers.items()] + [F.when(text == m, F.lit(n)) for n, m in (exact or {}).items()]
    origins = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
    plain = F.replace(text, F.lit(root), F.lit("<fixture>")) if root else text
    return found.select(
        key, "location", "role", F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"), F.sha2(plain, 256).alias("normalized_sha256"),
        F.when(F.size(origins) > 0, origins).otherwise(F.array(F.lit(UNKNOWN))).alias("origins"),
    )
