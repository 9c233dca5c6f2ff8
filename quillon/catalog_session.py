"""Queries over sessions: schema objects, micro-batches, controls, dictionaries,
snapshots and envelopes, each against a closed form or the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.catalog import BLOCK, _blocked, _bits, _integers, _sizes_sql, _sql_base, _table, _ubits, _uvs, _vs, _zz, register
from quillon.functions import sizes as S
from quillon.operators import blocks, encode, history
from quillon.operators.session import Decoder, Encoder, Field, Schema, read_words
from quillon.plans import selection


def _smallest(x):
    """Bytes of the width byte and the fewest of 1, 2, 4 or 8 bytes of a value >= 0."""
    return f"(CASE WHEN {x} < 256 THEN 2 WHEN {x} < 65536 THEN 3 WHEN {x} < 4294967296 THEN 5 ELSE 9 END)"


def _text(x):
    return f"({_vs(f'strlen({x})')} + strlen({x}))"


# ---------------------------------------------------------------- records


def _turns(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")


def _two(sender: Encoder, row: dict) -> bytes:
    return sender.encode_value({"turn": row["turn"], "role": row["role"]})


#: The first use of a key or string is a literal, later ones are references.
@register(
    "session_frame_size",
    f"""WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS seen,
  CASE WHEN turn >= 0 THEN 2 * turn ELSE -2 * turn - 1 END AS z FROM conversations)
SELECT conv_id, turn, CAST(2 + CASE WHEN i = 1 THEN 1 + 5 + 1 + 5 ELSE 2 + 2 END + 1 + {_smallest('z')}
  + 1 + CASE WHEN role = '' THEN 1 WHEN seen > 1 THEN 2 ELSE 1 + {_text('role')} END AS BIGINT) AS bytes FROM s""",
)
def session_frame_size(spark, sf_dir):
    frames = encode.session_frames(_turns(spark, sf_dir), ["conv_id"], ["turn"], ["turn", "role"], _two)
    return frames.select("conv_id", "turn", F.octet_length("frame").cast("long").alias("bytes"))


@register("session_value_roundtrip", "SELECT conv_id, turn, role FROM conversations")
def session_value_roundtrip(spark, sf_dir):
    frames = encode.session_frames(_turns(spark, sf_dir), ["conv_id"], ["turn"], ["turn", "role"], _two)
    back = encode.session_values(frames, ["conv_id"], ["turn"], "role string", lambda receiver, raw: {"role": dict(receiver.decode(raw))["role"]})
    return back.select("conv_id", "turn", "role")


@register(
    "session_message_kinds",
    "SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 'shaped' ELSE 'map' END AS kind FROM conversations",
)
def session_message_kinds(spark, sf_dir):
    """Three keys or more go out as a shape from the second time on."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    send = lambda sender, row: sender.encode_value({k: row[k] for k in ("turn", "role", "text")})
    frames = encode.session_frames(rows, ["conv_id"], ["turn"], ["turn", "role", "text"], send)
    return frames.select("conv_id", "turn", encode.message_kind("frame").alias("kind"))


# ---------------------------------------------------------------- schemas

#: An optional field, a range that some values leave, and an unranged string.
PART = Schema(9, "part", (
    Field(1, "p_partkey", "u64", True, None, 0, (1 << 32) - 1), Field(2, "p_brand", "string"),
    Field(3, "p_size", "u8", False, None, 0, 25), Field(4, "p_retailprice", "f64"),
))
_GAPPED = "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END"


def _gapped(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("p_partkey div 512 AS block", "p_partkey", "p_brand", f"CAST({_GAPPED} AS BIGINT) AS p_size", "p_retailprice")


def _schema_frames(spark, sf_dir):
    names = [f.name for f in PART.fields]
    send = lambda sender, row: sender.encode_with_schema(PART, encode.typed(PART, row))
    return encode.session_frames(_gapped(spark, sf_dir), ["block"], ["p_partkey"], names, send)


@register(
    "schema_object_size",
    f"""WITH s AS (SELECT p_partkey // 512 AS block, p_partkey, p_brand, {_GAPPED} AS size, row_number() OVER (PARTITION BY p_partkey // 512 ORDER BY p_partkey) AS i FROM part)
SELECT block, p_partkey, CAST(1 + CASE WHEN i = 1 THEN 2 ELSE 1 END + CASE WHEN size IS NULL THEN 3 ELSE 1 END + 1 + 1 + 5 + 1 + {_text('p_brand')}
  + CASE WHEN size IS NULL THEN 0 WHEN size BETWEEN 0 AND 25 THEN 2 ELSE 1 + {_smallest('size')} END + 8 AS BIGINT) AS bytes FROM s""",
)
def schema_object_size(spark, sf_dir):
    return _schema_frames(spark, sf_dir).select("block", "p_partkey", F.octet_length("frame").cast("long").alias("bytes"))


@register("schema_object_roundtrip", f"SELECT p_partkey // 512 AS block, p_partkey, p_brand, CAST({_GAPPED} AS BIGINT) AS p_size, p_retailprice FROM part")
def schema_object_roundtrip(spark, sf_dir):
    def read(receiver, raw):
        got = dict(receiver.decode(raw))
        return {"p_brand": got["p_brand"], "p_size": got.get("p_size"), "p_retailprice": got["p_retailprice"]}

    return encode.session_values(_schema_frames(spark, sf_dir), ["block"], ["p_partkey"], "p_brand string, p_size bigint, p_retailprice double", read, (PART,))


@register(
    "schema_checks",
    f"""SELECT p_partkey, CAST(CASE WHEN {_GAPPED} IS NULL THEN 0 ELSE 1 END AS BOOLEAN) AS present, coalesce({_GAPPED} BETWEEN 0 AND 25, false) AS in_range,
  p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AS in_enum, coalesce({_GAPPED}, 7) AS or_default FROM part""",
)
def schema_checks(spark, sf_dir):
    """Presence, range, enum and default as columns."""
    brand = Field(2, "p_brand", "string", enum=("Brand#11", "Brand#12", "Brand#13"))
    size = Field(3, "p_size", "u8", True, 7, 0, 25)
    rows = _gapped(spark, sf_dir)
    return rows.select(
        "p_partkey", F.col("p_size").isNotNull().alias("present"), selection.in_range(size).alias("in_range"),
        selection.in_enum(brand).alias("in_enum"), selection.or_default(size).alias("or_default"),
    )


# ---------------------------------------------------------------- batches


def _batches(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr("user_id % 2 AS source", "event_id div 64 AS batch", "event_id", "value", "event_type = 'click' AS click", "CAST(1 AS DOUBLE) AS one")
    struct = F.struct("event_id", "value", "click", "one")
    return rows.groupBy("source", "batch").agg(F.array_sort(F.collect_list(struct)).alias("rows"))


@register(
    "micro_batch_templates",
    """WITH b AS (SELECT user_id % 2 AS source, event_id // 64 AS batch, list(value ORDER BY event_id) AS v, list(event_type = 'click' ORDER BY event_id) AS c, count(*) AS n FROM events GROUP BY 1, 2)
SELECT source, batch, n, CAST(0 AS BIGINT) AS template, v IS DISTINCT FROM lag(v) OVER w AS sent_value, c IS DISTINCT FROM lag(c) OVER w AS sent_click, n IS DISTINCT FROM lag(n) OVER w AS sent_one
FROM b WINDOW w AS (PARTITION BY source ORDER BY batch)""",
)
def micro_batch_templates(spark, sf_dir):
    """Columns that a micro-batch sends: those that differ from the template's last batch."""
    def send(sender, row):
        return sender.encode_micro_batch([{k: r[k] for k in ("value", "click", "one")} for r in row["rows"]])

    def read(receiver, raw):
        # what the frame itself says, beside the batch that it stands for
        message = encode.message_of(receiver, raw)
        mask = message[3]
        return {"template": message[1], "n": len(receiver.decode(raw)), "sent_value": mask[0], "sent_click": mask[1], "sent_one": mask[2]}

    frames = encode.session_frames(_batches(spark, sf_dir), ["source"], ["batch"], ["rows"], send)
    return encode.session_values(frames, ["source"], ["batch"], "template bigint, n bigint, sent_value boolean, sent_click boolean, sent_one boolean", read)


@register("micro_batch_roundtrip", "SELECT user_id % 2 AS source, event_id // 64 AS batch, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def micro_batch_roundtrip(spark, sf_dir):
    def send(sender, row):
        return sender.encode_micro_batch([{k: r[k] for k in ("value", "click", "one")} for r in row["rows"]])

    frames = encode.session_frames(_batches(spark, sf_dir), ["source"], ["batch"], ["rows"], send)
    back = encode.session_values(frames, ["source"], ["batch"], "value array<double>", lambda receiver, raw: {"value": [r[0] for r in receiver.decode(raw)]})
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    return back.select("source", "batch", F.size("value").cast("long").alias("n"), F.round(total, 4).alias("total"), F.array_max("value").alias("most"))


def _priorities(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey div 512 AS block", "o_orderkey", "o_orderpriority")
    return encode.encode_batches(rows, ["block"], ["o_orderkey"], ["o_orderpriority"])


@register(
    "trained_dictionary",
    """SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY w) - 1 AS INTEGER) AS place, w AS word
FROM (SELECT DISTINCT o_orderkey // 512 AS block, o_orderpriority AS w FROM orders)""",
)
def trained_dictionary(spark, sf_dir):
    """The sorted words that a repetitive string column brings along."""
    def read(receiver, raw):
        column = encode.message_of(receiver, raw)[2][0]
        receiver.receive(raw)  # checks the payload's hash
        return {"words": read_words(receiver.state.dictionaries[column.dictionary])}

    back = encode.session_values(_priorities(spark, sf_dir), ["block"], [], "words array<string>", read)
    return back.select("block", F.posexplode("words").alias("place", "word"))


@register("trained_dictionary_roundtrip", "SELECT o_orderkey // 512 AS block, CAST(row_number() OVER (PARTITION BY o_orderkey // 512 ORDER BY o_orderkey) - 1 AS INTEGER) AS place, o_orderpriority FROM orders")
def trained_dictionary_roundtrip(spark, sf_dir):
    return encode.decode_batches(_priorities(spark, sf_dir), ["block"], "o_orderpriority string")


# ---------------------------------------------------------------- controls and snapshots


@register(
    "control_frame_size",
    f"""SELECT n_nationkey, CAST(3 + {_text('n_name')} AS BIGINT) AS keys, CAST(3 + {_text('n_name')} AS BIGINT) AS strings,
  CAST(4 + 1 + {_text('n_name')} + 1 + 2 AS BIGINT) AS shape, CAST(2 + 3 + 1 + {_text('n_name')} + 2 AS BIGINT) AS enum, CAST(2 AS BIGINT) AS reset_tables, CAST(2 AS BIGINT) AS reset_state FROM nation""",
)
def control_frame_size(spark, sf_dir):
    """Registers for keys, strings, shapes and enum codes, and both resets."""
    controls = {
        "keys": lambda t: ("control", "keys", [t]), "strings": lambda t: ("control", "strings", [t]), "shape": lambda t: ("control", "shape", 0, [t, "x"]),
        "enum": lambda t: ("control", "enum", "nm", [t, "x"]), "reset_tables": lambda t: ("control", "reset_tables"), "reset_state": lambda t: ("control", "reset_state"),
    }
    sizes = lambda text: {k: len(Encoder().send(make(text))) for k, make in controls.items()}
    rows = encode.per_row(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "s", "struct<" + ", ".join(f"{k}: bigint" for k in controls) + ">", ["n_name"], sizes)
    return rows.select("n_nationkey", "s.*")


@register("control_registers", "SELECT n_nationkey, n_name AS key, n_name AS string, n_name || ',x' AS shape, n_name || ',y' AS enum, CAST(0 AS BIGINT) AS left_after_reset FROM nation")
def control_registers(spark, sf_dir):
    """What a reader holds after the registers, and after a reset of the tables."""
    def run(text):
        sender, receiver = Encoder(), Decoder()
        for m in (("keys", [text]), ("strings", [text]), ("shape", 0, [text, "x"]), ("enum", "nm", [text, "y"])):
            receiver.receive(sender.send(("control", *m)))
        s = receiver.state
        out = {"key": s.keys[0], "string": s.strings[0], "shape": ",".join(s.shapes[0]), "enum": ",".join(s.enums["nm"])}
        receiver.receive(sender.send(("control", "reset_tables")))
        s = receiver.state
        return out | {"left_after_reset": len(s.keys) + len(s.strings) + len(s.shapes) + len(s.enums)}

    kind = "struct<key: string, string: string, shape: string, enum: string, left_after_reset: bigint>"
    return encode.per_row(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "s", kind, ["n_name"], run).select("n_nationkey", "s.*")


@register(
    "snapshots_kept",
    "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8",
)
def snapshots_kept(spark, sf_dir):
    """The snapshots that a reader still holds at the end: the last eight."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "value")

    def step(pair, e):
        sender, receiver = pair
        receiver.receive(sender.send(("snapshot", e["event_id"], 0, ("scalar", e["value"]))))

    def end(pair):
        return {"held": [{"event_id": k, "value": m[1]} for k, m in pair[1].state.snapshots.items()]}

    held = encode.session_ends(
        rows, ["user_id"], ["event_id", "value"], ["event_id", "value"], lambda: (Encoder(), Decoder()), step, "held array<struct<event_id: bigint, value: double>>", end
    )
    return held.select("user_id", F.inline("held"))


_FIELDS = ["event_type", "value"]


@register(
    "patch_or_full",
    f"""WITH l AS (SELECT user_id, event_id, event_type, value, lag(event_type) OVER w AS t, lag(value) OVER w AS v, row_number() OVER w = 1 AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, CAST(event_type IS DISTINCT FROM t AS INTEGER) AS dt, CAST(value IS DISTINCT FROM v AS INTEGER) AS dv FROM l)
SELECT user_id, event_id, NOT first AND ((dt + dv) / 3.0 <= 0.10 OR (2 * (dt + dv) <= 3 AND (dt + dv) / 3.0 <= 0.34)) AND 4 + dt * (3 + 2 + strlen(event_type) + 1) + dv * 12 < 40 AS patch FROM c""",
)
def patch_or_full(spark, sf_dir):
    """Whether a record of three fields goes out as a difference; 40 bytes are a full one."""
    rows = _table(spark, sf_dir, "events").withColumn("always", F.lit(1))
    changes = history.differences(rows, ["user_id"], ["event_id"], [*_FIELDS, "always"])
    text, value = F.col("set_event_type"), F.col("set_value")
    size = F.lit(4) + F.when(text.isNotNull(), 6 + F.octet_length(text["v"])).otherwise(0) + F.when(value.isNotNull(), 12).otherwise(0)
    return history.patch_choice(changes, [*_FIELDS, "always"], size, F.lit(40)).select("user_id", "event_id", "patch")


# ---------------------------------------------------------------- sizes


def _payloads(spark, sf_dir, codec):
    return encode.encode_vectors(_integers(spark, sf_dir, "orders"), ["block"], ["ord"], "v", "i64", codec)


_ORDERS = _sql_base("orders")


@register(
    "encoded_bytes_patched_for",
    f"""WITH o AS (SELECT block, row_number() OVER (PARTITION BY block ORDER BY ord) - 1 AS i, v - min(v) OVER (PARTITION BY block) AS x, min(v) OVER (PARTITION BY block) AS base FROM ({_ORDERS})),
w AS (SELECT *, greatest({_bits('max(x) OVER (PARTITION BY block)')} - 2, 0) AS bw FROM o),
m AS (SELECT *, {_bits('x')} > bw AS over, CAST(CASE WHEN {_bits('x')} > bw THEN x & ((1::BIGINT << bw) - 1) ELSE x END AS BIGINT) AS main FROM w)
SELECT block, count(*) AS n, CAST({_vs('count(*)')} + {_uvs(_zz('min(base)'))} + 1 + sum({_vs('main')}) + {_vs('count(CASE WHEN over THEN 1 END)')}
  + sum(CASE WHEN over THEN {_vs('i')} + {_vs('x')} ELSE 0 END) AS BIGINT) AS bytes FROM m GROUP BY block""",
)
def encoded_bytes_patched_for(spark, sf_dir):
    return _payloads(spark, sf_dir, "PATCHED_FOR").select("block", "n", F.octet_length("payload").cast("long").alias("bytes"))


_XOR_BYTES = f"""WITH b AS (SELECT event_id // {BLOCK} AS block, event_id AS ord, value::DOUBLE::BIT::BIGINT AS b FROM events),
x AS (SELECT *, xor(b, lag(b) OVER (PARTITION BY block ORDER BY ord)) AS x FROM b)
SELECT block, count(*) AS n, CAST({_vs('count(*)')} + 8 + coalesce(sum(CASE WHEN x IS NULL THEN 0 WHEN x = 0 THEN 1 ELSE 4 + CAST(ceil(length(rtrim(bin(x), '0')) / 7.0) AS BIGINT) END), 0) AS BIGINT) AS bytes FROM x GROUP BY block"""


@register("encoded_bytes_xor_float", _XOR_BYTES)
def encoded_bytes_xor_float(spark, sf_dir):
    rows = _blocked(_table(spark, sf_dir, "events"), "event_id", "value")
    return encode.encode_vectors(rows, ["block"], ["ord"], "v", "f64", "XOR_FLOAT").select("block", "n", F.octet_length("payload").cast("long").alias("bytes"))


@register("size_xor_float", _XOR_BYTES)
def size_xor_float(spark, sf_dir):
    """The same from the statistics, without encoding."""
    rows = _blocked(_table(spark, sf_dir, "events"), "event_id", "value")
    return blocks.float_statistics(rows, ["block"], ["ord"], "v").select("block", "n", F.col("xor_bytes").cast("long").alias("bytes"))


@register("encoded_bytes_bool", f"SELECT event_id // {BLOCK} AS block, count(*) AS n, CAST(3 + {_vs('count(*)')} + {_vs('count(*)')} + ceil(count(*) / 8.0) AS BIGINT) AS bytes FROM events GROUP BY 1")
def encoded_bytes_bool(spark, sf_dir):
    """Kind, element, count and codec, then the counted bitmap."""
    return _vector_frames(spark, sf_dir, "event_type = 'click'", "bool", "DIRECT_BITPACK")


@register("vector_frame_size", f"SELECT block, n, CAST(3 + {_vs('n')} + for_bytes AS BIGINT) AS bytes FROM ({_sizes_sql(_sql_base('events'))})")
def vector_frame_size(spark, sf_dir):
    """Message and vector headers around a payload of known size."""
    return _vector_frames(spark, sf_dir, "user_id", "i64", "FOR_BITPACK")


def _vector_frames(spark, sf_dir, value, element, codec):
    rows = _table(spark, sf_dir, "events").selectExpr(f"event_id div {BLOCK} AS block", "event_id", f"{value} AS v")
    lists = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("event_id", "v"))).getField("v").alias("values"))
    sized = encode.per_row(lists, "bytes", "bigint", ["values"], lambda values: len(Encoder().send(("vector", element, codec, values))))
    return sized.select("block", F.size("values").cast("long").alias("n"), "bytes")


_ONE_COLUMN = f"(5 + 1 + {_vs('count(*)')} + 1 + {_vs('count(*)')} + 8 * count(*))"


@register("column_batch_size", f"SELECT event_id // {BLOCK} AS block, count(*) AS n, CAST(1 + {_vs('count(*)')} + 1 + {_ONE_COLUMN} AS BIGINT) AS bytes FROM events GROUP BY 1")
def column_batch_size(spark, sf_dir):
    """Number, nulls, codec, dictionary and block flags, then the vector."""
    rows = _blocked(_table(spark, sf_dir, "events"), "event_id", "value")
    return encode.encode_batches(rows, ["block"], ["ord"], ["v"]).select("block", "n", F.octet_length("frame").cast("long").alias("bytes"))


@register("template_batch_size", f"SELECT event_id // {BLOCK} AS block, count(*) AS n, CAST(1 + 1 + {_vs('count(*)')} + 2 + 1 + {_ONE_COLUMN} AS BIGINT) AS bytes FROM events GROUP BY 1")
def template_batch_size(spark, sf_dir):
    """The same column as a template's first batch: template, rows, mask, columns."""
    rows = _blocked(_table(spark, sf_dir, "events"), "event_id", "value")
    lists = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("ord", "v"))).getField("v").alias("values"))
    sized = encode.per_row(lists, "bytes", "bigint", ["values"], lambda values: len(Encoder().encode_micro_batch([{"v": v} for v in values])))
    return sized.select("block", F.size("values").cast("long").alias("n"), "bytes")


PRICES = Schema(5, "prices", (Field(1, "v", "f64"),))


@register("schema_batch_size", f"SELECT event_id // {BLOCK} AS block, count(*) AS n, CAST(1 + 1 + {_vs('count(*)')} + 1 + 2 + 1 + {_vs('count(*)')} + 1 + {_vs('count(*)')} + 8 * count(*) AS BIGINT) AS bytes FROM events GROUP BY 1")
def schema_batch_size(spark, sf_dir):
    rows = _blocked(_table(spark, sf_dir, "events"), "event_id", "value")
    return encode.encode_schema_batches(rows, ["block"], ["ord"], PRICES).select("block", "n", F.octet_length("frame").cast("long").alias("bytes"))


@register(
    "select_codec_unsigned_wide",
    f"""WITH b AS (SELECT o_orderkey // {BLOCK} AS block, o_orderkey AS ord, CAST(o_custkey AS HUGEINT) * CASE WHEN (o_orderkey // {BLOCK}) % 2 = 0 THEN 10000000000000 ELSE 1 END + 9223372036854775808 AS v FROM orders),
l AS (SELECT *, lag(v) OVER (PARTITION BY block ORDER BY ord) AS prev, lead(v) OVER (PARTITION BY block ORDER BY ord) AS nxt FROM b),
s AS (SELECT block, count(*) AS n, {_ubits('max(v)')} AS width, {_ubits('max(v) - min(v)')} AS range_bits, sum(CASE WHEN v = prev OR v = nxt THEN 1 ELSE 0 END)::DOUBLE / count(*) AS repeated_ratio,
  count(*)::DOUBLE / sum(CASE WHEN v = prev THEN 0 ELSE 1 END) AS avg_run FROM l GROUP BY block)
SELECT block, n, CASE WHEN n < 4 THEN 'DIRECT_BITPACK' WHEN repeated_ratio >= 0.5 AND avg_run >= 3.0 THEN 'RLE' WHEN range_bits <= 60 THEN 'FOR_BITPACK'
  WHEN n >= 8 AND width <= 16 THEN 'SIMPLE8B' WHEN width < 64 THEN 'DIRECT_BITPACK' ELSE 'PLAIN' END AS codec FROM s""",
)
def select_codec_unsigned_wide(spark, sf_dir):
    """Unsigned values of 2**63 and more, as decimals."""
    rows = _table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey div {BLOCK} AS block", "o_orderkey AS ord",
        f"CAST(CAST(o_custkey AS DECIMAL(38, 0)) * (CASE WHEN (o_orderkey div {BLOCK}) % 2 = 0 THEN CAST(10000000000000 AS DECIMAL(20, 0)) ELSE CAST(1 AS DECIMAL(20, 0)) END) + CAST('9223372036854775808' AS DECIMAL(20, 0)) AS DECIMAL(20, 0)) AS v",
    )
    return blocks.unsigned_codec_wide(rows, ["block"], ["ord"], "v").select("block", "n", "codec")
