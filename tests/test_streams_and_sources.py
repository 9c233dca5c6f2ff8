"""Frame files, schemas, and the streaming twins of the session operators."""

import copy
import json
import random

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from quillon import catalog
from quillon.functions import control
from quillon.functions.wire import WireError
from quillon.operators import encode
from quillon.operators.session import Decoder, Encoder, Field, Schema
from quillon.sources import frames, schemas
from quillon.streaming import sessions
from tests.oracle import DATA


def test_frame_files(spark, tmp_path):
    (tmp_path / "frames.txt").write_text("codec|alpha|00060105616c706861\nsession|beta|0d4d0000030154\n")
    rows = frames.read_frames(spark, str(tmp_path / "frames.txt"))
    assert {(r.label, bytes(r.frame)[0]) for r in rows.collect()} == {("alpha", 0), ("beta", 13)}
    frames.write_frames(rows, str(tmp_path / "out"))
    assert {tuple(r) for r in frames.read_frames(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in rows.collect()}


def test_schemas_round_trip():
    schema = Schema(42, "record", (Field(1, "id", "u32", True, None, 1, 100), Field(2, "role", "string", True, None, None, None, ("a", "b")), Field(3, "age", "u8", False)))
    assert schemas.from_json(schemas.to_json(schema)) == schema
    assert schemas.from_struct(schemas.to_struct(schema), 42, "record") == schema


def _run(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return [r.asDict() for r in spark.table(name).collect()]


def test_stream_round_trip(spark, tmp_path):
    rows = [(u, s, f"v{s // 3}", float(s), "a constant tag") for u in range(3) for s in range(12)]
    source = spark.createDataFrame(rows, "user long, seq long, name string, x double, tag string")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    sent = _run(spark, sessions.encode_stream(stream, "user", "seq", ["name", "x", "tag"]), "sent")
    assert len(sent) == len(rows) and all(r["error"] is None for r in sent)
    assert any(bytes(r["frame"])[0] == 10 for r in sent)  # differences were used
    spark.createDataFrame(sent, "user long, seq long, part int, frame binary, error string").drop("error").write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema("user long, seq long, part int, frame binary").parquet(str(tmp_path / "frames"))
    got = _run(spark, sessions.decode_stream(stream, "user", "seq"), "got")
    back = {(r["user"], r["seq"]): {k: v["v"] for k, v in json.loads(r["json"])["v"]} for r in got}
    assert back == {(u, s): {"name": n, "x": x, "tag": t} for u, s, n, x, t in rows}


def test_gaps_and_steps_back_reset_the_session(spark, tmp_path):
    """Two micro-batches: the second begins with a gap for one key, a step back for the other."""
    schema = "user long, seq long, name string"
    for k, rows in enumerate(([(0, 1), (0, 2), (1, 1), (1, 2)], [(0, 5), (0, 6), (1, 2), (1, 3)])):
        spark.createDataFrame([(u, s, "name") for u, s in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = sessions.encode_stream(stream, "user", "seq", ["name"], gapless=True).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    sent = spark.read.parquet(str(tmp_path / "out")).collect()
    told = {(r.user, r.seq): r.error for r in sent if r.part == 0}
    assert told == {(0, 5): "record 5 came where 3 was due", (1, 2): "record 2 came where 3 was due"}
    assert {bytes(r.frame)[0] for r in sent if r.part == 0} == {8}
    frames = spark.createDataFrame([r for r in sent if r.user == 0], "user long, seq long, part int, frame binary, error string")
    frames.write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "frames"))
    got = _run(spark, sessions.decode_stream(stream, "user", "seq", gapless=True), "after_gap")
    assert sorted(r["seq"] for r in got) == [1, 2, 5, 6] and all(r["error"] is None for r in got)
    lost = frames.where("part = 1 and seq <> 2").drop("part")
    lost.write.parquet(str(tmp_path / "lost"))
    stream = spark.readStream.schema(lost.schema).parquet(str(tmp_path / "lost"))
    got = _run(spark, sessions.decode_stream(stream, "user", "seq", gapless=True), "lost")
    assert [r["error"] for r in got if r["seq"] == 5][0] == "record 5 came where 2 was due"


def test_streams_with_a_schema(spark, tmp_path):
    schema = Schema(3, "named", (Field(1, "name", "string"), Field(2, "x", "u64", False)))
    rows = spark.createDataFrame([(1, s, f"n{s}", None if s % 2 else s) for s in range(6)], "user long, seq long, name string, x long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sent = _run(spark, sessions.encode_stream(stream, "user", "seq", ["name"], mode=schema), "by_schema")
    assert len(sent) == 6 and {bytes(r["frame"])[0] for r in sent} == {4}


def test_options_round_trip():
    import pytest

    from quillon import SessionOptions

    options = SessionOptions(3, False, True, False, "statelessRetry")
    assert SessionOptions.from_json(options.to_json()) == options
    assert SessionOptions.from_json("{}") == SessionOptions() and options.encoder().state.snapshots_kept == 3
    for wrong in ({"snapshots": -1}, {"snapshots": 1.5}, {"unknown": "later"}):
        with pytest.raises(ValueError):
            SessionOptions(**wrong)


@pytest.mark.parametrize("name", ["micro_batch_templates", "micro_batch_roundtrip", "snapshots_kept"])
def test_sessions_are_streamed(spark, name):
    """No session is collected into one table or array of its events."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
    assert name != "snapshots_kept" or "collect_list" not in plan


def test_sessions_go_on_across_slices(spark, monkeypatch):
    events = [(k, i, float(i % 5)) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(events, "k long, i long, v double")
    batches = [pa.RecordBatch.from_pydict({"k": [0] * 5 + [1] * 7, "i": [*range(5), *range(7)]}), pa.RecordBatch.from_pydict({"k": [1] * 3 + [2], "i": [7, 8, 9, 0]})]
    monkeypatch.setattr(encode, "SESSION_ROWS", 4)
    parts = list(encode._in_order(batches, ["k"], list))
    assert [p.num_rows for p, _ in parts] == [4, 4, 4, 4]
    owners = [s for _, sessions in parts for s in sessions]
    assert len({id(s) for s in owners}) == 3 and len({id(s) for s in owners[5:15]}) == 1
    ends = encode.session_ends(df, ["k"], ["i"], ["i", "v"], list, lambda s, row: s.append(row["v"]), "n bigint, total double", lambda s: {"n": len(s), "total": sum(s)})
    assert sorted(map(tuple, ends.collect())) == [(k, 40, 80.0) for k in range(3)]


@pytest.mark.parametrize("coder", [control.HUFFMAN, control.FSE])
def test_lanes_of_one_file_are_coded_by_many_tasks(spark, coder):
    rows = spark.range(400, numPartitions=1).select(F.encode(F.concat(F.lit("lane "), "id"), "UTF-8").alias("raw"))
    coded = encode.code_lanes(rows, "raw", coder)
    assert coded.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(control.DECODE[coder](bytes(r.coded)) == bytes(r.raw) for r in coded.collect())


def test_shares_round_as_one_at_a_time():
    rng = random.Random(5)
    for _ in range(300):
        counts = {s: rng.choice([1, 2, 7, rng.randint(1, 3000)]) for s in rng.sample(range(256), rng.randint(1, 80))}
        total, share = sum(counts.values()), {s: max(n * 256 // sum(counts.values()), 1) for s, n in sorted(counts.items())}
        rest = lambda s: counts[s] * 256 - share[s] * total
        while (gap := 256 - sum(share.values())) != 0:
            if gap > 0:
                share[max(share, key=lambda s: (rest(s), -s))] += 1
            else:
                share[min((s for s in share if share[s] > 1), key=lambda s: (rest(s), s))] -= 1
        assert control._shares(counts) == share


def test_a_reader_forks_its_state():
    """A frame is read on a copy that shares what the state holds, and a bad one changes nothing."""
    sender, receiver = Encoder(), Decoder()
    for k in range(9):
        receiver.decode(sender.encode({"id": k, "name": f"n{k % 3}"}))
        receiver.receive(sender.send(("snapshot", k, 0, ("scalar", float(k)))))
    held = dict(receiver.state.snapshots)
    before = copy.deepcopy(receiver.state)
    with pytest.raises(WireError):
        receiver.receive(sender.send(("snapshot", 77, 0, ("scalar", 1.5))) + b"x")
    assert receiver.state == before
    receiver.receive(sender.encode({"id": 1, "name": "n1"}))
    assert all(receiver.state.snapshots[k] is m for k, m in held.items())
