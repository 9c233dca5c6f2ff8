"""Session frames: golden bytes, batches, patches, templates, atomic decoding."""

import pytest

from quillon.functions.dynamic import Entries
from quillon.functions.wire import UnknownReference, WireError
from quillon.operators.session import APPEND, DELETE, INSERT, KEEP, REPLACE, TRUNCATE, Decoder, Encoder, Field, Schema, Unsigned, apply_operations, columns_of

U = Unsigned
# Known frames of the wire format, in session order.
VALUE_FRAMES = [
    ("alpha", "00060105616c706861"),
    ({"id": U(1), "name": "alice"}, "02020002696404010100046e616d65060105616c696365"),
    ({"id": U(1), "name": "alice"}, "020201000401010101060201"),
]
SERIES_FRAMES = [
    (REPLACE, 0, 10_000, "0a00010001010302204e00"),
    (REPLACE, 0, 20_000, "0a00010001010302409c00"),
]
MICRO_FRAMES = [
    (["a", "b", "c", "d"], "0b00040203020003030000020403010402e40103000000040400040161016201630164"),
    (["aa", "bb", "cc", "dd"], "0b0004020201010300000004040004026161026262026363026464"),
]


def test_value_frames():
    sender, receiver = Encoder(), Decoder()
    for value, frame in VALUE_FRAMES:
        assert sender.encode_value(value).hex() == frame
        got = receiver.decode(bytes.fromhex(frame))
        assert got == (list(value.items()) if isinstance(value, dict) else value)


def test_prefixes_lean_on_the_longest_earlier_string():
    sender = Encoder()
    sender.encode_value("user-0")
    assert sender.encode_value("user-1").hex() == "00060300050131"


def test_series_and_patches():
    sender, receiver = Encoder(), Decoder()
    series = list(range(100))
    first = sender.encode(series)
    assert len(first) == 22 and receiver.decode(first) == series
    for _, at, value, frame in SERIES_FRAMES:
        changed = list(range(100))
        changed[at] = value
        raw = sender.encode_patch(changed)
        assert raw.hex() == frame and receiver.decode(raw) == changed
    many = [v + 10_000 if i < 12 else v for i, v in enumerate(series)]
    assert sender.encode_patch(many)[0] == 5


def test_micro_batches():
    sender, receiver = Encoder(), Decoder()
    for names, frame in MICRO_FRAMES:
        raw = sender.encode_micro_batch([{"id": U(i + 1), "name": n} for i, n in enumerate(names)])
        assert raw.hex() == frame
        assert receiver.decode(raw) == [[i + 1, n] for i, n in enumerate(names)]


def test_shapes_from_the_second_time_on():
    sender, receiver = Encoder(), Decoder()
    row = {"id": 1, "name": "a", "role": "b"}
    frames = [sender.encode_value(row) for _ in range(3)]
    assert [f[0] for f in frames] == [2, 3, 3]
    for f in frames[:1]:
        receiver.decode(f)
    receiver.state.observe(("id", "name", "role"))
    assert receiver.decode(frames[1]) == list(row.items())


def test_rows_then_columns():
    rows = [{"id": i, "extra": None if i % 3 == 0 else i} for i in range(20)]
    assert Encoder().encode_batch(rows[:15])[0] == 6
    raw = Encoder().encode_batch(rows)
    assert raw[0] == 7 and Decoder().decode(raw) == [[r["id"], r["extra"]] for r in rows]
    few = columns_of([{"x": None if i < 4 else i} for i in range(16)])[0]
    many = columns_of([{"x": None if i < 5 else i} for i in range(16)])[0]
    assert (few.nulls, many.nulls) == (2, 1)


def test_trained_dictionary():
    rows = [{"role": "admin" if i % 2 else "viewer"} for i in range(20)]
    raw = Encoder().encode_batch(rows)
    assert raw.count(b"viewer") == 1 and Decoder().decode(raw) == [[r["role"]] for r in rows]
    assert len(Encoder(dictionaries=False).encode_batch(rows)) > 0


USER = Schema(9, "user", (Field(1, "id", "u32", True, None, 1, 10_000_000), Field(2, "role", "string", True, None, None, None, ("viewer", "editor", "admin")), Field(3, "age", "u8", False, None, 0, 127)))


def test_schema_object_size_and_elided_id():
    sender, receiver = Encoder(), Decoder((USER,))
    row = {"id": U(1234), "role": "admin", "age": U(36)}
    first, second = sender.encode_with_schema(USER, row), sender.encode_with_schema(USER, row)
    assert (len(first), len(second)) == (14, 13)
    assert receiver.decode(first) == receiver.decode(second) == list(row.items())
    with pytest.raises(WireError):
        sender.encode_with_schema(USER, {"id": U(1)})
    out_of_range = sender.encode_with_schema(USER, {"id": U(20_000_000), "role": "editor"})
    assert receiver.decode(out_of_range) == [("id", 20_000_000), ("role", "editor")]


def test_bound_streams_and_schema_batches():
    rows = [{"id": U(i + 1), "role": "viewer"} | ({"age": U(i)} if i % 2 else {}) for i in range(6)]
    for encode in (Encoder.encode_bound_stream, Encoder.encode_batch_with_schema):
        raw = encode(Encoder(), USER, rows)
        assert [dict(r) for r in Decoder((USER,)).decode(raw)] == rows
        with pytest.raises(UnknownReference, match="schema_id"):
            Decoder().decode(raw)


def test_failed_frames_leave_the_state():
    sender, receiver = Encoder(), Decoder()
    snapshot = sender.send(("snapshot", 77, 0, ("scalar", 42)))
    assert snapshot.hex() == "0d4d0000030154"
    with pytest.raises(WireError, match="bytes are left"):
        receiver.receive(snapshot + b"\x00")
    assert receiver.state.snapshots == {}
    receiver.receive(snapshot)
    assert 77 in receiver.state.snapshots


def test_all_patch_operations():
    fields = [1, [1, 2, 3], "x"]
    done = apply_operations(fields, [(0, KEEP), (0, REPLACE, 5), (1, APPEND, [4]), (1, TRUNCATE, 2), (3, INSERT, "y"), (2, DELETE)])
    assert done == [5, [1, 2], "y"]
    assert apply_operations([1], [(0, REPLACE)], [9]) == [9]
    for bad in ([(5, REPLACE, 1)], [(0, APPEND, [1])], [(0, REPLACE)]):
        with pytest.raises(WireError):
            apply_operations([1], bad)


def test_controls_and_resets():
    sender, receiver = Encoder(), Decoder()
    for message in (("control", "keys", ["a"]), ("control", "strings", ["long string"]), ("control", "shape", 0, ["a", "b", "c"]), ("control", "enum", "role", ["x", "y"])):
        receiver.receive(sender.send(message))
    value = Entries([("role", "y"), ("a", "long string")])
    assert receiver.decode(sender.encode_value(value)) == value
    receiver.receive(sender.send(("control", "reset_state")))
    assert receiver.state.keys == [] and sender.state.keys == []
    assert receiver.receive(sender.send(("ext", 5, b"raw"))) == ("ext", 5, b"raw")


def test_unknown_references():
    with pytest.raises(UnknownReference):
        Decoder().decode(bytes.fromhex("020201000401010101060201"))
    with pytest.raises(UnknownReference, match="previous_message"):
        Decoder().decode(bytes.fromhex("0a00010001010302204e00"))


def test_snapshots_are_kept_to_a_limit():
    sender = Encoder(snapshots=3)
    for i in range(6):
        sender.encode(i)
    assert list(sender.state.snapshots) == [3, 4, 5]
