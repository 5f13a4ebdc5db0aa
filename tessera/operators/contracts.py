"""Closed-world record contracts over raw JSON: exact fields, strict types, bounds and vocabularies.

Rows are read as VARIANT, since a reader with a schema drops what it doesn't know and takes a boolean for an integer in places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field of a contract: its JSON type (string, int, bool, double, array, object), bounds or vocabulary."""

    name: str
    kind: str
    required: bool = True
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    words: tuple[str, ...] | None = None
    nonblank: bool = True
    distinct: bool = False


def _json_type(v: Column, name: str) -> Column:
    """The JSON type of a field as SCHEMA_OF_VARIANT names it, null where the field is absent."""
    return F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant"))


def _field_issue(v: Column, keys: Column, f: Field) -> Column:
    there = F.array_contains(keys, f.name)
    kind = _json_type(v, f.name)
    is_null = there & (kind == "VOID")
    text = F.try_variant_get(v, f"$['{f.name}']", "string")
    number = F.try_variant_get(v, f"$['{f.name}']", "double")
    right = {
        "string": kind == "STRING", "int": kind == "BIGINT", "bool": kind == "BOOLEAN", "double": kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"),
        "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT"),
    }[f.kind]
    bad = ~right
    if f.kind == "string" and f.nonblank:
        bad = bad | (F.trim(text) == "")
    if f.low is not None:
        bad = bad | (number < f.low)
    if f.high is not None:
        bad = bad | (number > f.high)
    if f.words is not None:
        bad = bad | ~text.isin(*f.words)
    if f.distinct:
        items = F.try_variant_get(v, f"$['{f.name}']", "array<string>")
        bad = bad | (F.size(F.array_distinct(items)) != F.size(items))
    wrong = F.coalesce(bad, F.lit(True))
    wrong = (~is_null & wrong) if f.nullable else (is_null | wrong)
    missing = F.lit(f"missing:{f.name}") if f.required else F.lit(None).cast("string")
    return F.when(~there, missing).when(wrong, F.lit(f"invalid:{f.name}"))


def violations(raw: Column, fields: tuple[Field, ...]) -> Column:
    """What a JSON text breaks of a contract, in order: not_an_object, or missing, invalid and unexpected fields."""
    v = F.try_parse_json(raw)
    keys = F.json_object_keys(raw)
    known = F.array(*(F.lit(f.name) for f in fields))
    extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unexpected:"), k))
    own = F.array_compact(F.array(*(_field_issue(v, keys, f) for f in fields)))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.concat(own, extra)).otherwise(F.array(F.lit("not_an_object")))


def validate(rows: DataFrame, raw: str, fields: tuple[Field, ...], mode: str = "flag") -> DataFrame:
    """``rows`` with ``violations``; in mode 'raise' the first row that breaks the contract fails the query."""
    out = rows.withColumn("violations", violations(F.col(raw), fields))
    if mode == "flag":
        return out
    fault = F.raise_error(F.concat(F.lit("contract broken: "), F.array_join("violations", ", ")))
    return out.withColumn("violations", F.when(F.size("violations") > 0, fault.cast("array<string>")).otherwise(F.col("violations")))


def paired_range_issue(c: Column, names: tuple[str, ...], required: tuple[str, ...]) -> Column:
    """Of a struct of min_x/max_x: the first name whose bounds aren't both set or both null, are swapped, negative or missing where required."""
    found = []
    for n in names:
        low, high = c[f"min_{n}"], c[f"max_{n}"]
        bad = (low.isNull() != high.isNull()) | F.coalesce((low > high) | (low < 0), F.lit(False))
        found.append(F.when(bad | (low.isNull() if n in required else F.lit(False)), n))
    return F.coalesce(*found)


def prompt_list(raw: Column) -> Column:
    """The user prompts of a generator's answer: a list, or an object's ``prompts`` or ``data``; items are texts or objects with user, user_input or prompt. Else empty."""
    from ..functions.text import drop_code_fence, strip

    v = F.try_parse_json(drop_code_fence(raw))
    none = F.array().cast("array<variant>")
    items = F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        *(F.when(F.size(F.try_variant_get(v, f"$.{k}", "array<variant>")) > 0, F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in ("prompts", "data")), none,
    )

    def user(item: Column) -> Column:
        of = lambda path: F.when(F.schema_of_variant(F.try_variant_get(item, path, "variant")) == "STRING", F.try_variant_get(item, path, "string"))
        first = lambda path: F.when(of(path) != "", of(path))
        return strip(F.coalesce(of("$"), first("$.user"), first("$.user_input"), first("$.prompt")))

    return F.filter(F.transform(items, user), lambda u: u.isNotNull() & (u != ""))


def ranking_issue(raw: Column, labels: tuple[str, ...]) -> Column:
    """Why a ranking's tiers don't part the labels, or null: tiers is a list of non-empty lists that hold each label once."""
    tiers = F.try_variant_get(F.try_parse_json(raw), "$.tiers", "array<array<string>>")
    flat = F.flatten(tiers)
    whole = F.array_sort(flat) == F.array(*(F.lit(x) for x in sorted(labels)))
    return F.when(tiers.isNull() | (F.size(tiers) == 0), "tiers_missing").when(F.exists(tiers, lambda t: F.size(t) == 0), "empty_tier").when(~F.coalesce(whole, F.lit(False)), "labels_incomplete")
