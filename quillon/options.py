"""Options of a session with their JSON form, and batches without a session."""

from __future__ import annotations

import json
from dataclasses import dataclass

from quillon.operators.session import Decoder, Encoder, Schema

# Option names and reference policies of the JSON form.
NAMES = {
    "snapshots": "maxBaseSnapshots", "patches": "enableStatePatch", "templates": "enableTemplateBatch",
    "dictionaries": "enableTrainedDictionary", "unknown": "unknownReferencePolicy",
}
FAIL, RETRY = "failFast", "statelessRetry"


@dataclass(frozen=True)
class SessionOptions:
    """What both ends of a session agree on; ``unknown`` says what to do about
    references that a reader cannot follow."""

    snapshots: int = 8
    patches: bool = True
    templates: bool = True
    dictionaries: bool = True
    unknown: str = FAIL

    def __post_init__(self):
        if isinstance(self.snapshots, bool) or not isinstance(self.snapshots, int) or self.snapshots < 0:
            raise ValueError(f"snapshots are a whole number from 0, not {self.snapshots!r}")
        if self.unknown not in (FAIL, RETRY):
            raise ValueError(f"unknown references {FAIL} or {RETRY}, not {self.unknown!r}")

    def encoder(self) -> Encoder:
        return Encoder(self.patches, self.templates, self.dictionaries, self.snapshots, self.unknown == RETRY)

    def decoder(self, schemas: tuple[Schema, ...] = ()) -> Decoder:
        return Decoder(schemas, self.snapshots, self.unknown == RETRY)

    def to_json(self) -> str:
        return json.dumps({name: getattr(self, k) for k, name in NAMES.items()}, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> "SessionOptions":
        """What the text leaves out has its default."""
        given = json.loads(text)
        return cls(**{k: given[name] for k, name in NAMES.items() if name in given})


def encode_batch(values: list) -> bytes:
    return Encoder().encode_batch(values)


def encode_with_schema(schema: Schema, value) -> bytes:
    return Encoder().encode_with_schema(schema, value)


def encode_bound_stream(schema: Schema, values: list) -> bytes:
    return Encoder().encode_bound_stream(schema, values)
