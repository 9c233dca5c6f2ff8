"""Stateful sessions on Structured Streaming: one encoder or decoder per key.

Records of a key must come in the order of ``seq``.  A step back, and with
``gapless`` a step of more than one, is an error and resets the session: a frame
of its own (``part`` 0) tells the reader, and the record follows as the first of
a fresh session.  A reader treats frames alike: it reports the error and starts
afresh.  State is the pickled session, committed with the micro-batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.functions import transport
from quillon.functions.dynamic import Entries
from quillon.functions.wire import WireError
from quillon.operators.encode import typed
from quillon.operators.session import Decoder, Encoder, Schema

STATE = "session binary, next long"
RESET = ("control", "reset_state")


def _misplaced(at: int, expected: int | None, gapless: bool) -> str | None:
    if expected is None or at == expected or at > expected and not gapless:
        return None
    return f"record {at} came where {expected} was due"


def encode_stream(df: DataFrame, key: str, seq: str, fields: list[str], mode: str | Schema = "patch", gapless: bool = False) -> DataFrame:
    """Frames of each key's records in order: (key, seq, part, frame, error).

    ``mode`` is ``value``, ``patch`` for differences where they are small, or a
    schema that every record follows.
    """
    if isinstance(mode, Schema):
        doubles = {f.name for f in mode.fields if f.family() == "f64"}
        whole = {f.name for f in mode.fields if f.family() in ("unsigned", "signed")}

        def send(sender: Encoder, record: Entries) -> bytes:
            # pandas holds integers beside nulls as doubles, and those nulls as NaN
            row = {k: v if k in doubles else None if pd.isna(v) else int(v) if k in whole else v for k, v in record}
            return sender.encode_with_schema(mode, typed(mode, row))
    else:
        send = {"value": Encoder.encode, "patch": Encoder.encode_patch}[mode]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, expected = (pickle.loads(state.get[0]), state.get[1]) if state.exists else (Encoder(), None)
        rows = pd.concat(list(frames)).sort_values(seq, kind="stable")
        out = []
        for record in rows.to_dict("records"):
            error = _misplaced(record[seq], expected, gapless)
            if error:
                session = Encoder()
                out.append((k[0], record[seq], 0, session.send(RESET), error))
            raw = send(session, Entries((f, record[f]) for f in fields))
            out.append((k[0], record[seq], 1, raw, None))
            expected = record[seq] + 1
        state.update((pickle.dumps(session), int(expected)))
        yield pd.DataFrame(out, columns=[key, seq, "part", "frame", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"`{key}` {kinds[key]}, `{seq}` {kinds[seq]}, part int, frame binary, error string"
    return df.select(key, seq, *fields).groupBy(key).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def decode_stream(df: DataFrame, key: str, seq: str, frame: str = "frame", gapless: bool = False, schemas: tuple[Schema, ...] = ()) -> DataFrame:
    """Values of each key's frames in order, as tagged JSON: (key, seq, json, error).
    ``part``, where the frames have it, orders frames of one record."""
    order = [seq, "part"] if "part" in df.columns else [seq]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, expected = (pickle.loads(state.get[0]), state.get[1]) if state.exists else (Decoder(schemas), None)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for record in rows.to_dict("records"):
            if record.get("part") == 0:  # the sender began afresh
                session, expected = Decoder(schemas), None
                continue
            lost = _misplaced(record[seq], expected, gapless)
            if lost:
                session = Decoder(schemas)
                out.append((k[0], record[seq], None, lost))
            try:
                value, error = transport.dumps(session.decode(record[frame])), None
            except WireError as e:  # the session keeps its state
                value, error = None, str(e)
            out.append((k[0], record[seq], value, error))
            expected = record[seq] + 1
        state.update((pickle.dumps(session), int(expected or 0)))
        yield pd.DataFrame(out, columns=[key, seq, "json", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"`{key}` {kinds[key]}, `{seq}` {kinds[seq]}, json string, error string"
    return df.select(key, *order, frame).groupBy(key).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)
