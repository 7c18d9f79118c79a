"""JSON contracts compiled to a column: what a document breaks, as a list of 'path: problem'.

A contract is a JSON schema as a dict. Documents are parsed once to a variant; each rule becomes an expression on a path of it, items of
arrays go through higher-order functions, so a contract of any depth is one projection.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a date-time must look like.
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
KNOWN = {
    "type", "const", "enum", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "format", "required", "properties", "additionalProperties", "minProperties",
    "items", "prefixItems", "minItems", "maxItems", "uniqueItems", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref", "$defs", "$schema", "$id", "title", "description", "default", "examples", "$comment",
}


class _At:
    """A place in a document: its variant with its kind and keys, worked out once, and how the place is called."""

    def __init__(self, bound: Column, name: Column):
        self.value, self.kind, self.keys, self.name = bound["v"], bound["kind"], bound["keys"], name

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    def key(self, key: str) -> tuple[Column, Column]:
        return F.try_variant_get(self.value, f"$['{key}']", "variant"), F.concat(self.name, F.lit(f".{key}"))

    def says(self, broken: Column, problem: str) -> Column:
        return F.when(broken, F.concat(self.name, F.lit(f": {problem}")))


def _bound(value: Column) -> Column:
    """The variant with its kind (object, array, string, number, integer, boolean, null, or a null where there is nothing) and keys."""
    shape = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    kind = (
        F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null")
        .when(shape.isNotNull(), F.when(number == F.floor(number), "integer").otherwise("number"))
    )
    keyed = F.struct(value.alias("v"), kind.alias("kind"))
    keys = lambda z: F.when(z["kind"] == "object", F.map_keys(F.try_variant_get(z["v"], "$", "map<string,variant>")))
    return F.element_at(F.transform(F.array(keyed), lambda z: F.struct(z["v"].alias("v"), z["kind"].alias("kind"), keys(z).alias("keys"))), 1)


def _literal(value) -> tuple[str, Column]:
    """Kind and value of a constant of a schema."""
    if value is None:
        return "null", F.lit(None)
    if isinstance(value, bool):
        return "boolean", F.lit(value)
    if isinstance(value, (int, float)):
        return "number", F.lit(float(value))
    if isinstance(value, str):
        return "string", F.lit(value)
    raise ValueError(f"constants are plain values, not {value!r}")


def _equals(at: _At, value) -> Column:
    kind, literal = _literal(value)
    if kind == "null":
        return at.kind == "null"
    if kind == "number":
        return F.coalesce(at.kind.isin("number", "integer") & (at.get("double") == literal), F.lit(False))
    return F.coalesce((at.kind == kind) & (at.get(kind) == literal), F.lit(False))


def _none() -> Column:
    return F.array().cast("array<string>")


def _broken(at: _At, schema, root: dict) -> list[Column]:
    """Arrays of problems of a present value."""
    if schema is True:
        return []
    if schema is False:
        return [F.array(F.concat(at.name, F.lit(": not allowed")))]
    if odd := set(schema) - KNOWN:
        raise ValueError(f"no rule for {sorted(odd)}")
    one: list[Column] = []
    more: list[Column] = []
    kind = at.kind
    number, text = kind.isin("number", "integer"), kind == "string"
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].removeprefix("#/").split("/"):
            target = target[step]
        more += _broken(at, target, root)
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        allowed = [*kinds, *(["integer"] if "number" in kinds else [])]
        one.append(at.says(~kind.isin(*allowed), f"not {' or '.join(kinds)}"))
    if "const" in schema:
        one.append(at.says(~_equals(at, schema["const"]), f"not {json.dumps(schema['const'])}"))
    if "enum" in schema:
        hit = F.lit(False)
        for v in schema["enum"]:
            hit = hit | _equals(at, v)
        one.append(at.says(~hit, "not one of " + ", ".join(json.dumps(v) for v in schema["enum"])))
    size = F.char_length(at.get("string"))
    value = at.get("double")
    for rule, on, broken, word in (
        ("minimum", number, lambda b: value < b, "below"), ("maximum", number, lambda b: value > b, "above"),
        ("exclusiveMinimum", number, lambda b: value <= b, "not above"), ("exclusiveMaximum", number, lambda b: value >= b, "not below"),
        ("minLength", text, lambda b: size < b, "shorter than"), ("maxLength", text, lambda b: size > b, "longer than"),
    ):
        if rule in schema:
            one.append(at.says(on & broken(schema[rule]), f"{word} {schema[rule]}"))
    if "pattern" in schema:
        one.append(at.says(text & ~at.get("string").rlike(schema["pattern"]), f"does not match {schema['pattern']}"))
    if schema.get("format") == "date-time":
        one.append(at.says(text & ~at.get("string").rlike(DATE_TIME), "not a date-time"))
    is_object, is_array = kind == "object", kind == "array"
    keys = at.keys
    named = schema.get("properties", {})
    for key in schema.get("required", []):
        one.append(F.when(is_object & ~F.array_contains(keys, key), F.concat(at.name, F.lit(f".{key}: missing"))))
    if "minProperties" in schema:
        one.append(at.says(is_object & (F.size(keys) < schema["minProperties"]), f"fewer than {schema['minProperties']} keys"))
    extra = schema.get("additionalProperties", True)
    known = F.array(*[F.lit(k) for k in named]) if named else _none()
    if extra is False:
        more.append(F.when(is_object, F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(at.name, F.lit("."), k, F.lit(": unknown")))))
    elif isinstance(extra, dict):
        pairs = F.filter(F.map_entries(at.get("map<string,variant>")), lambda e: ~F.array_contains(known, e["key"]))
        more.append(F.when(is_object, F.flatten(F.transform(pairs, lambda e: _all(e["value"], F.concat(at.name, F.lit("."), e["key"]), extra, root)))))
    for key, sub in named.items():
        more.append(F.when(is_object & F.array_contains(keys, key), _all(*at.key(key), sub, root)))
    items = at.get("array<variant>")
    place = lambda i: F.concat(at.name, F.lit("["), i.cast("string"), F.lit("]"))
    first = schema.get("prefixItems", [])
    for n, sub in enumerate(first):
        inner = F.try_variant_get(at.value, f"$[{n}]", "variant"), F.concat(at.name, F.lit(f"[{n}]"))
        more.append(F.when(is_array & (F.size(items) > n), _all(*inner, sub, root)))
    if "items" in schema and schema["items"] is not True:
        rest = F.flatten(F.transform(items, lambda x, i: F.when(i >= len(first), _all(x, place(i), schema["items"], root)).otherwise(_none())))
        more.append(F.when(is_array, rest))
    if "minItems" in schema:
        one.append(at.says(is_array & (F.size(items) < schema["minItems"]), f"fewer than {schema['minItems']} items"))
    if "maxItems" in schema:
        one.append(at.says(is_array & (F.size(items) > schema["maxItems"]), f"more than {schema['maxItems']} items"))
    if schema.get("uniqueItems"):
        texts = F.transform(items, lambda x: F.to_json(x))
        one.append(at.says(is_array & (F.size(F.array_distinct(texts)) < F.size(texts)), "repeated items"))
    for sub in schema.get("allOf", []):
        more += _broken(at, sub, root)
    fits = lambda sub: F.size(_joined(at, sub, root)) == 0
    for rule, least, most, problem in (("anyOf", 1, None, "fits none of the choices"), ("oneOf", 1, 1, "does not fit exactly one choice")):
        if rule in schema:
            n = sum((fits(sub).cast("int") for sub in schema[rule]), F.lit(0))
            one.append(at.says((n < least) | (n > most if most else F.lit(False)), problem))
    if "not" in schema:
        one.append(at.says(fits(schema["not"]), "fits what it must not"))
    if "if" in schema:
        then, other = schema.get("then", True), schema.get("else", True)
        more.append(F.when(fits(schema["if"]), _joined(at, then, root)).otherwise(_joined(at, other, root)))
    return [*([F.array_compact(F.array(*one))] if one else []), *more]


def _joined(at: _At, schema, root: dict) -> Column:
    parts = [F.coalesce(p, _none()) for p in _broken(at, schema, root)]
    return F.concat(*parts) if parts else _none()


def _all(value: Column, name: Column, schema, root: dict) -> Column:
    return F.element_at(F.transform(F.array(_bound(value)), lambda z: _joined(_At(z, name), schema, root)), 1)


def check(documents: DataFrame, column: str, schema: dict, out: str = "violations") -> DataFrame:
    """documents with what the JSON text in ``column`` breaks of a contract: sorted, distinct 'path: problem', none for a good one.

    A null or malformed text is '$: malformed', one with a key twice in an object, at any depth, '$: repeated key'; neither is
    looked into. Numbers are compared as doubles. A rule that the compiler does not know raises when it is compiled.
    """
    whole = _all(F.col("_variant"), F.lit("$"), schema, schema)
    unread = F.when(F.get_json_object(column, "$").isNotNull(), F.lit("$: repeated key")).otherwise(F.lit("$: malformed"))
    parsed = documents.withColumn("_variant", F.try_parse_json(column))  # a step of its own: every rule reads it
    found = F.when(F.col("_variant").isNull(), F.array(unread)).otherwise(F.array_sort(F.array_distinct(whole)))
    return parsed.withColumn(out, found).drop("_variant")
