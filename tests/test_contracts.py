"""Contracts compiled to columns against documents with known faults."""

import json

import pytest

from freshet.operators import contracts

REQUEST = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "additionalProperties": False,
    "required": ["schema", "window", "interval_minutes", "units"],
    "properties": {
        "schema": {"const": "request/1"},
        "window": {"type": "object", "additionalProperties": False, "required": ["start"], "properties": {"start": {"type": "string", "format": "date-time"}, "zone": {"type": "string", "minLength": 1}}},
        "interval_minutes": {"type": "integer", "minimum": 1, "maximum": 1440},
        "units": {"enum": ["CMS", "CFS", None, 7, True]},
        "sha256": {"type": "string", "pattern": "^[0-9a-f]{8}$"},
    },
}
GOOD = {"schema": "request/1", "window": {"start": "2024-01-01T00:00:00Z"}, "interval_minutes": 60, "units": "CMS"}

GRID = {
    "type": "object",
    "properties": {
        "origin": {"prefixItems": [{"type": "number"}, {"type": "number"}], "items": False, "minItems": 2},
        "cells": {"type": "array", "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/cell"}},
    },
    "additionalProperties": {"type": "string"},
    "minProperties": 1,
    "$defs": {"cell": {"type": "array", "items": {"type": ["integer", "null"]}, "minItems": 1}},
}

CHOICE = {
    "oneOf": [{"type": "object", "required": ["a"]}, {"type": "object", "required": ["b"]}],
    "anyOf": [{"type": "object"}, {"type": "array"}],
    "allOf": [{"not": {"required": ["bad"]}}],
    "if": {"required": ["a"]},
    "then": {"properties": {"a": {"exclusiveMinimum": 0, "exclusiveMaximum": 10, "type": "number"}}},
    "else": {"properties": {"b": {"maxLength": 2}}},
}

CASES = [
    (REQUEST, GOOD, []),
    (REQUEST, GOOD | {"interval_minutes": 60.0, "units": None, "sha256": "0123abcd"}, []),
    (REQUEST, GOOD | {"x y": 1, "a": {}}, ["$.a: unknown", "$.x y: unknown"]),
    (REQUEST, {}, ["$.interval_minutes: missing", "$.schema: missing", "$.units: missing", "$.window: missing"]),
    (REQUEST, GOOD | {"schema": "request/2", "interval_minutes": 0, "units": 8, "sha256": "0123abcdX"}, ["$.interval_minutes: below 1", '$.schema: not "request/1"', '$.sha256: does not match ^[0-9a-f]{8}$', '$.units: not one of "CMS", "CFS", null, 7, true']),
    (REQUEST, GOOD | {"window": {"start": "yesterday", "zone": "", "end": 1}, "interval_minutes": 2.5}, ["$.interval_minutes: not integer", "$.window.end: unknown", "$.window.start: not a date-time", "$.window.zone: shorter than 1"]),
    (REQUEST, GOOD | {"window": None, "interval_minutes": True, "units": "7"}, ["$.interval_minutes: not integer", '$.units: not one of "CMS", "CFS", null, 7, true', "$.window: not object"]),
    (REQUEST, [1], ["$: not object"]),
    (GRID, {"origin": [1, 2.5], "cells": [[1, None], [2]], "note": "x"}, []),
    (GRID, {"origin": [1, "2", 3], "cells": [[1], [], [1], ["x", 1.5]], "note": 4}, ["$.cells: more than 3 items", "$.cells: repeated items", "$.cells[1]: fewer than 1 items", "$.cells[3][0]: not integer or null", "$.cells[3][1]: not integer or null", "$.note: not string", "$.origin[1]: not number", "$.origin[2]: not allowed"]),
    (GRID, {}, ["$: fewer than 1 keys"]),
    (CHOICE, {"a": 5}, []),
    (CHOICE, {"a": 10}, ["$.a: not below 10"]),
    (CHOICE, {"b": "long"}, ["$.b: longer than 2"]),
    (CHOICE, {"a": 1, "b": 2, "bad": 3}, ["$: does not fit exactly one choice", "$: fits what it must not"]),
    (CHOICE, 3, ["$: does not fit exactly one choice", "$: fits none of the choices", "$: fits what it must not"]),
]


@pytest.mark.parametrize("k", range(3))
def test_violations(spark, k):
    schema = (REQUEST, GRID, CHOICE)[k]
    cases = [(json.dumps(d), want) for s, d, want in CASES if s is schema]
    cases += [(None, ["$: malformed"]), ("", ["$: malformed"]), ("{", ["$: malformed"]), ('{"a": 1, "a": 2}', ["$: repeated key"]), ('{"window": {"start": "x", "start": "y"}}', ["$: repeated key"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string")
    got = {r.id: r.violations for r in contracts.check(df, "text", schema).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i] == want, text
    assert contracts.check(df, "text", schema).columns == ["id", "text", "violations"]


def test_unknown_rules_are_refused(spark):
    with pytest.raises(ValueError):
        contracts.check(spark.createDataFrame([("{}",)], "text string"), "text", {"multipleOf": 3})
