"""Format schemas as ``StructType`` metadata and as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import types as T

from quillon.operators.session import Field, Schema

_TYPES = {"unsigned": T.LongType(), "signed": T.LongType(), "bool": T.BooleanType(), "f64": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType()}


def to_struct(schema: Schema) -> T.StructType:
    fields = []
    for f in schema.fields:
        meta = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(f).items() if v not in (None, ())}
        fields.append(T.StructField(f.name, _TYPES.get(f.family(), T.StringType()), not f.required, meta))
    return T.StructType(fields)


def from_struct(struct: T.StructType, schema_id: int, name: str) -> Schema:
    """Uses the metadata where it is there; plain fields get their natural kind."""
    kinds = {"bigint": "i64", "int": "i32", "smallint": "i16", "tinyint": "i8", "boolean": "bool", "double": "f64", "string": "string", "binary": "binary"}
    fields = []
    for i, f in enumerate(struct.fields, start=1):
        meta = dict(f.metadata or {})
        meta["enum"] = tuple(meta.get("enum", ()))
        base = {"number": i, "name": f.name, "kind": kinds.get(f.dataType.simpleString(), "string"), "required": not f.nullable}
        fields.append(Field(**(base | meta)))
    return Schema(schema_id, name, tuple(fields))


def to_json(schema: Schema) -> str:
    return json.dumps({"schemaId": schema.id, "name": schema.name, "fields": [asdict(f) for f in schema.fields]}, separators=(",", ":"))


def from_json(text: str) -> Schema:
    raw = json.loads(text)
    return Schema(raw["schemaId"], raw["name"], tuple(Field(**(f | {"enum": tuple(f["enum"])})) for f in raw["fields"]))
