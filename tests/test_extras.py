"""Bit-grouped bodies, zero packing, vocabularies, pools, compression, data source."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import extras
from quillon.functions.wire import Reader, WireError
from quillon.operators.session import Field, Schema

RECORD = Schema(1, "r", (
    Field(1, "id", "u32", True, None, 1, 10_000_000), Field(2, "role", "string", True, None, None, None, ("viewer", "editor", "admin")),
    Field(3, "age", "u8", False, None, 0, 127), Field(4, "active", "bool"), Field(5, "score", "i64", False), Field(6, "name", "string", False), Field(7, "x", "f64", False),
))


def test_bodies_pack_bits_together():
    row = {"id": 1234, "role": "admin", "age": 36, "active": True}
    raw = extras.encode_body(RECORD, row)
    assert len(raw) == 1 + -(-(24 + 2 + 7 + 1) // 8)
    assert extras.decode_body(RECORD, raw) == row


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 10_000_000), st.sampled_from(["viewer", "editor", "admin"]), st.none() | st.integers(0, 127), st.booleans(), st.none() | st.integers(-(1 << 62), 1 << 62), st.none() | st.text(max_size=9))
def test_body_round_trip(i, role, age, active, score, name):
    row = {k: v for k, v in {"id": i, "role": role, "age": age, "active": active, "score": score, "name": name}.items() if v is not None}
    assert extras.decode_body(RECORD, extras.encode_body(RECORD, row)) == row


def test_bodies_reject():
    good = {"id": 5, "role": "viewer", "active": False}
    for bad in ({"id": 0}, {"role": "owner"}, {"id": None}):
        with pytest.raises(WireError):
            extras.encode_body(RECORD, good | bad)
    raw = extras.encode_body(RECORD, good)
    with pytest.raises(WireError, match="padding|beyond the last flag"):
        extras.decode_body(RECORD, bytes([raw[0] | 0x80]) + raw[1:])
    with pytest.raises(WireError, match="padding|beyond the last flag"):
        extras.decode_body(RECORD, raw[:-1] + bytes([raw[-1] | 0x80]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 255]), max_size=100).map(bytes))
def test_zero_packing(data):
    assert extras.zero_unpack(extras.zero_pack(data)) == data
    if extras.zero_packing_pays(data):
        assert len(extras.zero_pack(data)) < len(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=9), max_size=20))
def test_pools(blobs):
    assert extras.unpool_blobs(extras.pool_blobs(blobs)) == blobs


def test_vocabulary_and_compression():
    v = extras.Vocabulary(["GET", "PUT"])
    assert (v.encode("PUT"), v.decode(Reader(v.encode("other"))), v.decode(Reader(b"\x01"))) == (b"\x02", "other", "GET")
    for block in (b"", b"short", bytes(5000), bytes(range(256)) * 3):
        raw = extras.compress(block)
        assert extras.decompress(raw) == block and len(raw) <= len(block) + 1


def test_data_source(spark, tmp_path):
    from quillon.sources import datasource

    datasource.register(spark)
    (tmp_path / "a.txt").write_text("codec|x|00060105616c706861\nsession|y|0d4d0000030154\n")
    (tmp_path / "b.txt").write_text("codec|z|0003010e\n")
    df = spark.read.format("quillon_frames").load(str(tmp_path))
    assert df.count() == 3
    assert {r.label for r in df.where("kind = 'scalar'").collect()} == {"x", "z"}
    assert {r.label for r in df.where("stream = 'codec' and label <> 'z'").collect()} == {"x"}
