"""Byte codecs over DataFrames: vectors, batches, records and dynamic values.

Groups are dealt by their block columns and handed to Python as Arrow tables,
one block at a time; blocks are bounded by the format's limit of 2**20 values.
Sessions have no such bound: their rows come sorted and are taken in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import control, dynamic, transport, vectors
from quillon.functions.wire import Reader
from quillon.operators import session

Names = list[str]
_ELEMENT_TYPES = {"i64": "bigint", "u64": "bigint", "f64": "double", "string": "string"}


def _fields(df: DataFrame, names: Names) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def _sorted(table: pa.Table, order: Names) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in order])


def encode_vectors(df: DataFrame, block: Names, order: Names, value: str, element: str, codec: str | None = None) -> DataFrame:
    """(block, n, codec, payload): one encoded vector per block; without a
    ``codec`` the selection rules choose."""

    def run(key, table):
        values = _sorted(table, order).column(value).to_pylist()
        name = codec or vectors.CHOOSERS[element](values)
        raw = vectors.ENCODERS[element](values, name)
        arrays = [*(pa.array([k.as_py()], k.type) for k in key), pa.array([len(values)], pa.int64()), pa.array([name]), pa.array([raw], pa.binary())]
        return pa.Table.from_arrays(arrays, [*block, "n", "codec", "payload"])

    rows = df.select(*dict.fromkeys([*block, *order, value]))
    return rows.groupBy(*block).applyInArrow(run, f"{_fields(df, block)}, n long, codec string, payload binary")


def decode_vectors(df: DataFrame, block: Names, element: str) -> DataFrame:
    """(block, place, value): the inverse of ``encode_vectors``."""

    def run(batches):
        for b in batches:
            lists = [vectors.DECODERS[element](Reader(raw), codec) for raw, codec in zip(b.column("payload").to_pylist(), b.column("codec").to_pylist())]
            kind = {"f64": pa.float64(), "string": pa.string()}.get(element, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in block), pa.array(lists, pa.list_(kind))], [*block, "values"])

    wide = df.select(*block, "codec", "payload").mapInArrow(run, f"{_fields(df, block)}, values array<{_ELEMENT_TYPES[element]}>")
    return wide.select(*block, F.posexplode("values").alias("place", "value"))


def _batches(df: DataFrame, block: Names, order: Names, columns: Names, frame) -> DataFrame:
    """One frame per block, made by ``frame(rows)``; null cells are left out."""

    def run(key, table):
        rows = _sorted(table, order).select(columns).to_pylist()
        raw = frame(rows)
        arrays = [*(pa.array([k.as_py()], k.type) for k in key), pa.array([len(rows)], pa.int64()), pa.array([raw], pa.binary())]
        return pa.Table.from_arrays(arrays, [*block, "n", "frame"])

    rows = df.select(*dict.fromkeys([*block, *order, *columns]))
    return rows.groupBy(*block).applyInArrow(run, f"{_fields(df, block)}, n long, frame binary")


def encode_batches(df: DataFrame, block: Names, order: Names, columns: Names) -> DataFrame:
    """Row layout below 16 rows, column layout from there on."""
    return _batches(df, block, order, columns, lambda rows: session.Encoder().encode_batch([dynamic.Entries(r.items()) for r in rows]))


def decode_batches(df: DataFrame, block: Names, schema: str) -> DataFrame:
    """(block, place, columns of ``schema``): frames carry ordinals, not names."""
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        for b in batches:
            out = [[dict(zip(target.names, [*r, *[None] * (len(target) - len(r))])) for r in session.Decoder().decode(raw)] for raw in b.column("frame").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in block), pa.array(out, pa.list_(_arrow_struct(target)))], [*block, "rows"])

    wide = df.select(*block, "frame").mapInArrow(run, f"{_fields(df, block)}, rows array<{target.simpleString()}>")
    return wide.select(*block, F.posexplode("rows").alias("place", "row")).select(*block, "place", "row.*")


def _arrow_struct(schema) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema)


def typed(schema: session.Schema, row: dict) -> dynamic.Entries:
    """A row for a schema: integers of unsigned fields are marked so."""
    unsigned = {f.name for f in schema.fields if f.family() == "unsigned"}
    return dynamic.Entries((k, session.Unsigned(v) if k in unsigned and v is not None else v) for k, v in row.items() if k in {f.name for f in schema.fields})


def encode_schema_batches(df: DataFrame, block: Names, order: Names, schema: session.Schema) -> DataFrame:
    names = [f.name for f in schema.fields]
    return _batches(df, block, order, names, lambda rows: session.Encoder().encode_batch_with_schema(schema, [typed(schema, r) for r in rows]))


def encode_bound_streams(df: DataFrame, block: Names, order: Names, schema: session.Schema) -> DataFrame:
    names = [f.name for f in schema.fields]
    return _batches(df, block, order, names, lambda rows: session.Encoder().encode_bound_stream(schema, [typed(schema, r) for r in rows]))


def decode_with_schema(df: DataFrame, block: Names, schema: session.Schema) -> DataFrame:
    """(block, place, fields): rows of schema batches and bound streams."""
    kinds = {"unsigned": "bigint", "signed": "bigint", "bool": "boolean", "f64": "double", "string": "string", "binary": "binary"}
    target = df.sparkSession.createDataFrame([], ", ".join(f"`{f.name}` {kinds[f.family()]}" for f in schema.fields)).schema

    def run(batches):
        for b in batches:
            out = [[dict(r) for r in session.Decoder((schema,)).decode(raw)] for raw in b.column("frame").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in block), pa.array(out, pa.list_(_arrow_struct(target)))], [*block, "rows"])

    wide = df.select(*block, "frame").mapInArrow(run, f"{_fields(df, block)}, rows array<{target.simpleString()}>")
    return wide.select(*block, F.posexplode("rows").alias("place", "row")).select(*block, "place", "row.*")


def per_row(df: DataFrame, name: str, kind: str, columns: Names, convert) -> DataFrame:
    """Adds ``name``: ``convert`` of the row's ``columns``, batch by batch."""
    from pyspark.sql.types import _parse_datatype_string

    out = _arrow_struct(_parse_datatype_string(kind))

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in columns))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([convert(*r) for r in rows], out)], [*b.schema.names, name])

    return df.mapInArrow(run, f"{_fields(df, df.columns)}, `{name}` {kind}")


def encode_rows(df: DataFrame, columns: Names, name: str = "frame") -> DataFrame:
    """Each row's columns as one self-describing map."""
    return per_row(df, name, "binary", columns, lambda *v: dynamic.encode(dynamic.Entries(zip(columns, v)), signed=True))


def decode_rows(df: DataFrame, frame: str = "frame", name: str = "json") -> DataFrame:
    """Self-describing frames as tagged JSON (read on with ``from_json`` or variant)."""
    return per_row(df, name, "string", [frame], lambda raw: transport.dumps(dynamic.decode(raw)))


def code_lanes(df: DataFrame, column: str, coder: int, name: str = "coded") -> DataFrame:
    """Adds each lane's frame.  Rows are dealt out first: coding takes far longer
    than reading, and a table in few files would be coded by few tasks."""
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return per_row(dealt, name, "binary", [column], lambda raw: None if raw is None else control.ENCODE[coder](bytes(raw)))


def decode_lanes(df: DataFrame, column: str, coder: int, name: str = "lane") -> DataFrame:
    return per_row(df, name, "binary", [column], lambda raw: None if raw is None else control.DECODE[coder](bytes(raw)))


def payload_hash(df: DataFrame, column: str, name: str = "hash") -> DataFrame:
    """FNV-1a of a binary column, as the bits of a long."""
    return per_row(df, name, "bigint", [column], lambda raw: None if raw is None else (session.fnv1a(raw) + (1 << 63)) % (1 << 64) - (1 << 63))


def _plain(array: pa.Array) -> list:
    """``to_pylist``, with numbers and records in lists taken by column."""
    kind = array.type
    if pa.types.is_list(kind) and not array.null_count:
        cells, ends = _plain(array.flatten()), array.value_lengths().to_numpy().cumsum().tolist()
        return [cells[lo:hi] for lo, hi in zip([0, *ends], ends)]
    if pa.types.is_struct(kind) and not array.null_count and kind.num_fields:
        names = [f.name for f in kind]
        return [dict(zip(names, row)) for row in zip(*map(_plain, array.flatten()))]
    if not array.null_count and (pa.types.is_integer(kind) or pa.types.is_float64(kind) or pa.types.is_boolean(kind)):
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def _rows(part: pa.RecordBatch, columns: Names) -> list[dict]:
    return [dict(zip(columns, row)) for row in zip(*(_plain(part.column(c)) for c in columns))]


#: Rows that a session's task holds as Python values.
SESSION_ROWS = 256


def _ranked(df: DataFrame, key: Names, order: Names) -> DataFrame:
    """Rows dealt by ``key``, and sorted by it and ``order``.  The number of parts
    is given, as few long sessions would else be joined in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *key).sortWithinPartitions(*key, *(F.asc_nulls_last(c) for c in order))


def _in_order(batches, key: Names, begin) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of sorted batches, with each row's session: a key's first row
    gets a new one from ``begin()``."""
    at, now = None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, SESSION_ROWS):
            part, sessions = batch.slice(lo, SESSION_ROWS), []
            for place in zip(*(_plain(part.column(c)) for c in key)):
                if now is None or place != at:
                    at, now = place, begin()
                sessions.append(now)
            yield part, sessions


def session_frames(df: DataFrame, key: Names, order: Names, columns: Names, send) -> DataFrame:
    """(key, order, frame): one session per key, ``send(encoder, row)`` for each
    record in order."""
    kinds = _fields(df, [*key, *order])

    def run(batches):
        for part, senders in _in_order(batches, key, session.Encoder):
            raw = [send(sender, row) for sender, row in zip(senders, _rows(part, columns))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*key, *order]), pa.array(raw, pa.binary())], [*key, *order, "frame"])

    rows = df.select(*dict.fromkeys([*key, *order, *columns]))
    return _ranked(rows, key, order).mapInArrow(run, f"{kinds}, frame binary")


def session_values(df: DataFrame, key: Names, order: Names, fields: str, read, schemas: tuple = ()) -> DataFrame:
    """(key, order, fields): one reader per key, ``read(decoder, frame)`` gives
    the fields of each frame in order."""
    target = df.sparkSession.createDataFrame([], fields).schema

    def run(batches):
        for part, receivers in _in_order(batches, key, lambda: session.Decoder(schemas)):
            got = [read(receiver, raw) for receiver, raw in zip(receivers, part.column("frame").to_pylist())]
            values = [pa.array([g[f.name] for g in got], t.type) for f, t in zip(target, _arrow_struct(target))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*key, *order]), *values], [*key, *order, *target.names])

    kinds = _fields(df, [*key, *order])
    return _ranked(df.select(*key, *order, "frame"), key, order).mapInArrow(run, f"{kinds}, {fields}")


def session_ends(df: DataFrame, key: Names, order: Names, columns: Names, begin, step, fields: str, end) -> DataFrame:
    """(key, fields): one session per key, made by ``begin()``; after ``step(session,
    row)`` for each row in order, ``end(session)`` gives the fields."""
    target = df.sparkSession.createDataFrame([], fields).schema
    kinds = _arrow_struct(df.select(*key).schema)

    def run(batches):
        done, at, now = [], (), None

        def flush():
            keys = [pa.array(c, t.type) for c, t in zip(zip(*(k for k, _ in done)), kinds)]
            values = [pa.array([v[f.name] for _, v in done], t.type) for f, t in zip(target, _arrow_struct(target))]
            return pa.RecordBatch.from_arrays([*keys, *values], [*key, *target.names])

        for part, sessions in _in_order(batches, key, begin):
            for own, place, row in zip(sessions, zip(*(_plain(part.column(c)) for c in key)), _rows(part, columns)):
                if own is not now:
                    if now is not None:
                        done.append((at, end(now)))
                    at, now = place, own
                step(own, row)
            if len(done) >= SESSION_ROWS:
                yield flush()
                done.clear()
        if now is not None:
            done.append((at, end(now)))
            yield flush()

    rows = df.select(*dict.fromkeys([*key, *order, *columns]))
    return _ranked(rows, key, order).mapInArrow(run, f"{_fields(df, key)}, {fields}")


def message_of(receiver: session.Decoder, raw: bytes) -> tuple:
    """What a frame says itself, read on a copy of the session."""
    return session.FrameReader(receiver.state.fork(), raw).message()


def message_kind(frame: str) -> Column:
    """The kind of a session frame, from its first byte."""
    code = F.conv(F.hex(F.substring(frame, 1, 1)), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, session.KINDS)), code + 1)
