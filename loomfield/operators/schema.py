"""Nested JSON schemas compiled to column expressions over parsed values."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<path:string,code:string>>"
#: What Spark names the kinds of parsed values; whole numbers beyond 64 bits are decimals without a fraction.
KINDS = {"object": r"^OBJECT", "array": r"^ARRAY", "string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\((19|[23][0-9]),0\))$", "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": r"^BOOLEAN$", "null": r"^VOID$"}
KEYWORDS = {"object": ("required", "properties", "additionalProperties"), "array": ("minItems", "maxItems", "uniqueItems", "items"), "string": ("minLength", "maxLength", "pattern"), "integer": ("minimum", "maximum")}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _resolved(schema: dict, root: dict) -> dict:
    """The schema that a local reference leads to."""
    seen = []
    while "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#/") or ref in seen:
            raise ValueError(f"not a reference within the schema: {ref}")
        seen.append(ref)
        schema = root
        for part in ref[2:].split("/"):
            schema = schema[part.replace("~1", "/").replace("~0", "~")]
    return schema


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _marks(path: Column, *rules: tuple[Column, str]) -> Column:
    """path and code of each rule that is broken; null does not count."""
    found = [F.when(F.coalesce(broken, F.lit(False)), F.struct(path.alias("path"), F.lit(code).alias("code"))) for broken, code in rules]
    return F.array_compact(F.array(*found)).cast(FOUND) if found else F.array().cast(FOUND)


def _object(value: Column, schema: dict, root: dict, path: Column) -> Column:
    def fields(held: Column) -> Column:
        keys = F.map_keys(held)
        below = lambda name: F.concat(path, F.lit("."), F.lit(name))
        parts = [_marks(below(k), (~F.array_contains(keys, k), "required")) for k in schema.get("required", [])]
        properties = schema.get("properties", {})
        if schema.get("additionalProperties") is False:
            odd = F.array_except(keys, F.array(*map(F.lit, properties)).cast("array<string>"))
            parts.append(F.transform(odd, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("additionalProperty").alias("code"))))
        for name, child in properties.items():
            parts.append(F.when(F.array_contains(keys, name), _errors(held[name], child, root, below(name))).otherwise(F.array().cast(FOUND)))
        return F.concat(F.array().cast(FOUND), *parts)

    return _bound(F.try_variant_get(value, "$", "map<string,variant>"), fields)


def _array(value: Column, schema: dict, root: dict, path: Column) -> Column:
    def items(held: Column) -> Column:
        rules = [(F.size(held) < schema["minItems"], "minItems")] if "minItems" in schema else []
        rules += [(F.size(held) > schema["maxItems"], "maxItems")] if "maxItems" in schema else []
        rules += [(F.size(F.array_distinct(F.transform(held, lambda x: F.to_json(x)))) < F.size(held), "uniqueItems")] if schema.get("uniqueItems") else []
        own = _marks(path, *rules)
        if "items" not in schema:
            return own
        each = F.transform(held, lambda x, i: _errors(x, schema["items"], root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.concat(own, F.flatten(each))

    return _bound(F.try_variant_get(value, "$", "array<variant>"), items)


def _string(value: Column, schema: dict, root: dict, path: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    rules = [(F.length(text) < schema["minLength"], "minLength")] if "minLength" in schema else []
    rules += [(F.length(text) > schema["maxLength"], "maxLength")] if "maxLength" in schema else []
    rules += [(~F.regexp_like(text, F.lit(rf"\A(?:{schema['pattern']})\z")), "pattern")] if schema.get("pattern") else []
    return _marks(path, *rules)


def _integer(value: Column, schema: dict, root: dict, path: Column) -> Column:
    number = F.try_variant_get(value, "$", "decimal(38,0)")
    rules = [(number < schema["minimum"], "minimum")] if "minimum" in schema else []
    rules += [(number > schema["maximum"], "maximum")] if "maximum" in schema else []
    return _marks(path, *rules)


PARTS = {"object": _object, "array": _array, "string": _string, "integer": _integer}


def _errors(value: Column, schema: dict, root: dict, path: Column) -> Column:
    """Array of path and code of all that a value breaks."""
    schema = _resolved(schema, root)
    expected = schema.get("type")
    kind = F.schema_of_variant(value)

    def body(held: Column) -> Column:
        of = lambda name: F.regexp_like(held, F.lit(KINDS[name]))
        text = F.coalesce(F.to_json(value), F.lit("null"))
        fixed = []
        if "const" in schema:
            fixed.append((text != _json(schema["const"]), "const"))
        if "enum" in schema:
            fixed.append((~text.isin([_json(v) for v in schema["enum"]]), "enum"))
        out = _marks(path, *fixed)
        for name, part in PARTS.items():
            if expected in (None, name) and any(k in schema for k in KEYWORDS[name]):
                out = F.concat(out, F.when(of(name), part(value, schema, root, path)).otherwise(F.array().cast(FOUND)))
        if expected:
            wrong = F.array(F.struct(path.alias("path"), F.lit(f"type={expected}").alias("code"))).cast(FOUND)
            out = F.when(of(expected), out).otherwise(wrong)
        return out

    return _bound(kind, body)


def schema_violations(payloads: DataFrame, schema: dict) -> DataFrame:
    """job_id, code, path of all that JSON texts (job_id, json) break of a schema.

    Of a schema count const, enum, type (object, array, string, integer, and
    number, boolean, null), required, properties, additionalProperties (false),
    minItems, maxItems, uniqueItems, items, minLength, maxLength, pattern (of the
    whole text), minimum, maximum, and local $ref. A path begins with $; a
    value of another type than expected is that violation alone. A text that is null or
    no JSON, as one that repeats a field, is ``not_json``. Everything
    is checked within the row, so nothing is shuffled.
    """
    parsed = payloads.select("job_id", F.try_parse_json("json").alias("value"))
    found = F.when(F.col("value").isNull(), _marks(F.lit("$"), (F.lit(True), "not_json"))).otherwise(_errors(F.col("value"), schema, schema, F.lit("$")))
    return parsed.select("job_id", F.explode(found).alias("v")).select("job_id", "v.code", "v.path")
