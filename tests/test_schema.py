"""Schema violations at nested paths equal those of a plain walk."""

import json
import random
import re

import pytest

from loomfield.operators.schema import schema_violations

SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["a", "b", "s"],
    "properties": {
        "a": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "string", "minLength": 2, "maxLength": 4}},
        "b": {"type": "array", "items": {"$ref": "#/$defs/o"}}, "s": {"const": 2}, "e": {"enum": ["x", 1, None]}, "n": {"type": "integer", "minimum": 1, "maximum": 9},
        "any": {"minLength": 2, "minimum": 3, "maxItems": 1}, "f": {"type": "number"}, "t": {"type": "boolean"}, "z/y~x": {"type": "null"}},
    "$defs": {
        "o": {"type": "object", "additionalProperties": False, "required": ["t"], "properties": {"t": {"type": "string", "pattern": "[0-9]{2}|é+"}, "in": {"$ref": "#/$defs/p~1q"}}},
        "p/q": {"type": "array", "items": {"type": "integer"}}}}
VALUES = [None, True, 0, 1, 5, 10, 10**20, 2.5, 2.0, "", "x", "12", "12\n", "éé", "abcde", [], ["ab", "ab"], ["ab", "c"], [1, "2", 2.0], {}, {"t": "12", "in": [1, False]}, {"q": 1}, [{"t": "1"}, 3, {"t": "12", "in": [[]], "u": 0}]]


def is_kind(value, kind):
    whole = isinstance(value, int) and not isinstance(value, bool)
    return {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "integer": whole, "number": whole or isinstance(value, float), "boolean": isinstance(value, bool), "null": value is None}[kind]


def walk(value, schema, path="$"):
    if "$ref" in schema:
        at = SCHEMA
        for part in schema["$ref"][2:].split("/"):
            at = at[part.replace("~1", "/").replace("~0", "~")]
        schema = at
    if "type" in schema and not is_kind(value, schema["type"]):
        yield path, "type=" + schema["type"]
        return
    value_ = int(value) if isinstance(value, float) and value.is_integer() else value  # numbers are equal by value
    text = json.dumps(value_)
    checks = {
        "const": lambda c: text != json.dumps(c), "enum": lambda e: text not in map(json.dumps, e),
        "minItems": lambda n: isinstance(value, list) and len(value) < n, "maxItems": lambda n: isinstance(value, list) and len(value) > n,
        "uniqueItems": lambda u: isinstance(value, list) and len({json.dumps(v, sort_keys=True) for v in value}) < len(value),
        "minLength": lambda n: isinstance(value, str) and len(value) < n, "maxLength": lambda n: isinstance(value, str) and len(value) > n,
        "pattern": lambda p: isinstance(value, str) and not re.fullmatch(p, value),
        "minimum": lambda n: is_kind(value, "integer") and value < n, "maximum": lambda n: is_kind(value, "integer") and value > n}
    yield from ((path, k) for k, broken in checks.items() if k in schema and broken(schema[k]))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from ((f"{path}.{k}", "required") for k in schema.get("required", []) if k not in value)
        yield from ((f"{path}.{k}", "additionalProperty") for k in value if schema.get("additionalProperties") is False and k not in known)
        for k in known.keys() & value.keys():
            yield from walk(value[k], known[k], f"{path}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            yield from walk(v, schema["items"], f"{path}[{i}]")


def test_nested_violations_equal_a_plain_walk(spark):
    rng = random.Random(7)
    good = {"a": ["ab"], "b": [{"t": "12", "in": [1]}], "s": 2, "e": None, "n": 3}
    values = [*VALUES, good]
    for _ in range(150):
        values.append({**good, **{k: rng.choice(VALUES) for k in rng.sample([*SCHEMA["properties"], "odd"], 3)}})
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "job_id long, json string").repartition(3)
    got = sorted((r.job_id, r.path, r.code) for r in schema_violations(df, SCHEMA).collect())
    assert got == sorted((i, *found) for i, v in enumerate(values) for found in walk(v, SCHEMA))


def test_texts_that_are_no_json(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{a"), (4, '{"a":1,"a":2}'), (5, "2")], "job_id long, json string")
    got = sorted((r.job_id, r.code, r.path) for r in schema_violations(df, {"const": 2}).collect())
    assert got == [(i, "not_json", "$") for i in range(1, 5)]
    with pytest.raises(ValueError, match="reference"):
        schema_violations(df, {"$ref": "other.json"})
