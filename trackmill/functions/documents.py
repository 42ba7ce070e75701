"""JSON document expressions: parsing, checks and canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.checks import valid_run_id
from trackmill.schemas import MANIFEST_DOCUMENT, METRICS_DOCUMENT, STAGE_FIELDS, ddl


def parse_manifest(text: Column) -> Column:
    """Typed view of a manifest document.

    A section that is not an object reads as null, a leaf of the wrong type
    reads as null without harming its neighbours. ``stages`` keeps each list
    entry as text, because one odd entry would otherwise null the whole list.
    """
    return F.from_json(text, MANIFEST_DOCUMENT)


def parse_stages(stages: Column) -> Column:
    """Turn the stage texts into structs; an entry that is no object has null fields."""
    kind = ddl(STAGE_FIELDS)
    empty = F.from_json(F.lit("{}"), kind)
    return F.transform(stages, lambda entry: F.coalesce(F.from_json(entry, kind), empty))


def parse_metrics(text: Column) -> Column:
    """Typed view of a processing-metrics document."""
    return F.from_json(text, METRICS_DOCUMENT)


def with_json(rows: DataFrame, text: str, name: str = "json") -> DataFrame:
    """Add a struct column that holds one strict and one lenient parse of a text.

    In brackets, a document parses to a one-element list only if nothing but
    white space follows it. The lenient parse (it accepts NaN and Infinity) runs
    only where the strict one fails. Being a column of its own, the parse is
    done once however many checks look at it.
    """
    boxed = F.concat(F.lit("["), F.col(text), F.lit("]"))
    strict = rows.withColumn(f"_{name}", F.try_parse_json(boxed))
    whole = F.col(f"_{name}")
    return strict.withColumn(
        name,
        F.struct(
            F.try_variant_get(whole, "$[0]", "variant").alias("value"),
            F.try_variant_get(whole, "$[1]", "variant").isNull().alias("single"),
            F.when(whole.isNull(), F.from_json(boxed, "array<map<string,string>>")).alias("loose"),
        ),
    ).drop(f"_{name}")


def _loose_members(json: Column) -> Column:
    return F.when(F.size(json["loose"]) == 1, F.get(json["loose"], 0))


def is_json(json: Column) -> Column:
    """True when the text is one JSON value; NaN and Infinity are accepted in objects."""
    strict = json["value"].isNotNull() & json["single"]
    return strict | F.coalesce(_loose_members(json).isNotNull(), F.lit(False))


def is_object(json: Column, text: Column) -> Column:
    """True when the (valid) JSON text is an object."""
    return is_json(json) & text.rlike(r"\A\s*\{")


def _member_type(json: Column, path: str) -> Column:
    """JSON type name at a path (``VOID`` for a JSON null), null when absent."""
    return F.schema_of_variant(F.try_variant_get(json["value"], path, "variant"))


def truthy(value: Column) -> Column:
    """Whether a variant counts as true: not null, false, 0 or empty."""
    kind = F.schema_of_variant(value)
    body = F.to_json(value)
    return (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", body == "true")
        .when(kind == "STRING", body != '""')
        .when(kind.startswith("ARRAY"), body != "[]")
        .when(kind.startswith("OBJECT"), body != "{}")
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def manifest_error(json: Column, text: Column, file_stem: Column) -> Column:
    """First problem of an archived manifest, null for a good one."""
    run_id = F.coalesce(
        F.try_variant_get(json["value"], "$.run_id", "string"),
        F.try_element_at(_loose_members(json), F.lit("run_id")),
    )
    other_type = _member_type(json, "$.run_id") != "STRING"
    return (
        F.when(~is_json(json), "Invalid JSON")
        .when(~is_object(json, text), "Manifest root value must be an object")
        .when(run_id.isNull() | other_type, "Manifest must contain a string run_id")
        .when(~valid_run_id(run_id), "Run ID is not safe")
        .when(run_id != file_stem, "Manifest run_id does not match its filename")
    )


def stages_error(json: Column) -> Column:
    """Problem text when ``stages`` is present but not a list."""
    kind = _member_type(json, "$.stages")
    return F.when(~kind.startswith("ARRAY"), "Pipeline manifest stages must be a list")


def canonical_json(text: Column, strict: Column | None = None) -> Column:
    """Same document with sorted keys and no spaces; unchanged if not strict JSON.

    ``strict`` is the already parsed variant, when the caller has it.
    """
    parsed = F.try_parse_json(text) if strict is None else strict
    return F.coalesce(F.to_json(parsed), text)
