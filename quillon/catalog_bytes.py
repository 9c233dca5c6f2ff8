"""Queries over the byte codecs, histories and the relational surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.catalog import _CHOICE, BLOCK, _blocked, _integers, _sizes_sql, _sql_base, _stats_sql, _strings, _strings_sql, _table, _vs, register
from quillon.functions import control
from quillon.functions import sizes as S
from quillon.operators import blocks, encode, history
from quillon.operators.session import Field, Schema
from quillon.streaming import run, sessions

_ORDERS = _sql_base("orders")

for _codec, _column in (("PLAIN", "plain"), ("DIRECT_BITPACK", "direct"), ("DELTA_BITPACK", "delta"), ("FOR_BITPACK", "for"), ("DELTA_FOR_BITPACK", "delta_for"), ("DELTA_DELTA_BITPACK", "delta_delta"), ("RLE", "rle")):
    # Measured payloads against the closed form: the two engines share no code.
    @register(f"encoded_bytes_{_column}", f"SELECT block, n, {_column}_bytes AS bytes FROM ({_sizes_sql(_ORDERS)})")
    def _measured(spark, sf_dir, codec=_codec):
        frames = encode.encode_vectors(_integers(spark, sf_dir, "orders"), ["block"], ["ord"], "v", "i64", codec)
        return frames.select("block", "n", F.octet_length("payload").cast("long").alias("bytes"))

    @register(f"decoded_{_column}", f"SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY ord) - 1 AS INTEGER) AS place, v AS value FROM ({_ORDERS})")
    def _back(spark, sf_dir, codec=_codec):
        frames = encode.encode_vectors(_integers(spark, sf_dir, "orders"), ["block"], ["ord"], "v", "i64", codec)
        return encode.decode_vectors(frames, ["block"], "i64")


for _codec in ("SIMPLE8B", "PATCHED_FOR"):
    @register(f"decoded_{_codec.lower()}", f"SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY ord) - 1 AS INTEGER) AS place, v AS value FROM ({_ORDERS})")
    def _special(spark, sf_dir, codec=_codec):
        frames = encode.encode_vectors(_integers(spark, sf_dir, "orders"), ["block"], ["ord"], "v", "i64", codec)
        return encode.decode_vectors(frames, ["block"], "i64")


for _codec, _column in (("PLAIN", "plain"), ("DICTIONARY", "dictionary"), ("PREFIX_DELTA", "prefix")):
    @register(f"encoded_bytes_string_{_column}", f"SELECT block, n, {_column}_bytes AS bytes FROM ({_strings_sql('customer')})")
    def _text(spark, sf_dir, codec=_codec):
        frames = encode.encode_vectors(_strings(spark, sf_dir, "customer"), ["block"], ["ord"], "v", "string", codec)
        return frames.select("block", "n", F.octet_length("payload").cast("long").alias("bytes"))

    @register(f"decoded_string_{_column}", f"SELECT c_custkey // {BLOCK} AS block, CAST(row_number() OVER (PARTITION BY c_custkey // {BLOCK} ORDER BY c_custkey) - 1 AS INTEGER) AS place, c_name AS value FROM customer")
    def _text_back(spark, sf_dir, codec=_codec):
        frames = encode.encode_vectors(_strings(spark, sf_dir, "customer"), ["block"], ["ord"], "v", "string", codec)
        return encode.decode_vectors(frames, ["block"], "string")


for _codec in ("PLAIN", "XOR_FLOAT"):
    @register(f"decoded_float_{_codec.lower()}", f"SELECT event_id // {BLOCK} AS block, CAST(row_number() OVER (PARTITION BY event_id // {BLOCK} ORDER BY event_id) - 1 AS INTEGER) AS place, value FROM events")
    def _floats(spark, sf_dir, codec=_codec):
        rows = _blocked(_table(spark, sf_dir, "events"), "event_id", "value")
        return encode.decode_vectors(encode.encode_vectors(rows, ["block"], ["ord"], "v", "f64", codec), ["block"], "f64")


@register("selected_codecs", _stats_sql(_ORDERS) + f"SELECT block, n, {_CHOICE} AS codec FROM stats")
def selected_codecs(spark, sf_dir):
    """Codecs that the byte encoder picks; tests compare them with the plan's."""
    return encode.encode_vectors(_integers(spark, sf_dir, "orders"), ["block"], ["ord"], "v", "i64").select("block", "n", "codec")


def _customers(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey div 256 AS block", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("column_batch_roundtrip", f"SELECT c_custkey // 256 AS block, CAST(row_number() OVER (PARTITION BY c_custkey // 256 ORDER BY c_custkey) - 1 AS INTEGER) AS place, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def column_batch_roundtrip(spark, sf_dir):
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    frames = encode.encode_batches(_customers(spark, sf_dir), ["block"], ["c_custkey"], names)
    return encode.decode_batches(frames, ["block"], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@register(
    "sparse_batch_roundtrip",
    "SELECT d.doc_id // 128 AS block, CAST(row_number() OVER (PARTITION BY d.doc_id // 128 ORDER BY d.doc_id) - 1 AS INTEGER) AS place, d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def sparse_batch_roundtrip(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left").withColumn("block", F.expr("doc_id div 128"))
    frames = encode.encode_batches(rows, ["block"], ["doc_id"], ["doc_id", "quality", "toxic"])
    return encode.decode_batches(frames, ["block"], "doc_id long, quality int, toxic int")


#: 25 nations make columns, 5 regions rows; sizes follow from the layout.
@register(
    "row_batch_size",
    f"""SELECT count(*) AS n, CAST(1 + {_vs('count(*)')} + sum(1 + 1 + 2 + 2 + {_vs('strlen(r_name)')} + strlen(r_name)) AS BIGINT) AS bytes FROM region""",
)
def row_batch_size(spark, sf_dir):
    rows = _table(spark, sf_dir, "region").withColumn("block", F.lit(0))
    frames = encode.encode_batches(rows, ["block"], ["r_regionkey"], ["r_regionkey", "r_name"])
    return frames.select("n", F.octet_length("frame").cast("long").alias("bytes"))


PART = Schema(7, "part", (
    Field(1, "p_partkey", "u64", True, None, 0, (1 << 32) - 1), Field(2, "p_brand", "string"), Field(3, "p_size", "u8", True, None, 0, 127), Field(4, "p_retailprice", "f64"),
))


def _parts(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("p_partkey div 512 AS block", "p_partkey", "p_brand", "p_size", "p_retailprice")


_PART_ROWS = "SELECT p_partkey // 512 AS block, CAST(row_number() OVER (PARTITION BY p_partkey // 512 ORDER BY p_partkey) - 1 AS INTEGER) AS place, p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"


@register("schema_batch_roundtrip", _PART_ROWS)
def schema_batch_roundtrip(spark, sf_dir):
    return encode.decode_with_schema(encode.encode_schema_batches(_parts(spark, sf_dir), ["block"], ["p_partkey"], PART), ["block"], PART)


@register("bound_stream_roundtrip", _PART_ROWS)
def bound_stream_roundtrip(spark, sf_dir):
    return encode.decode_with_schema(encode.encode_bound_streams(_parts(spark, sf_dir), ["block"], ["p_partkey"], PART), ["block"], PART)


@register(
    "bound_stream_size",
    f"""SELECT p_partkey // 512 AS block, count(*) AS n, CAST(1 + {_vs('7')} + {_vs('count(*)')} + 1
  + sum(1 + 4 + 1 + {_vs('strlen(p_brand)')} + strlen(p_brand) + 1 + 1 + 8) AS BIGINT) AS bytes FROM part GROUP BY 1""",
)
def bound_stream_size(spark, sf_dir):
    frames = encode.encode_bound_streams(_parts(spark, sf_dir), ["block"], ["p_partkey"], PART)
    return frames.select("block", "n", F.octet_length("frame").cast("long").alias("bytes"))


@register(
    "dynamic_int_width",
    """SELECT o_orderkey, CAST(CASE WHEN o_custkey BETWEEN -32 AND 127 THEN 1 WHEN o_custkey BETWEEN -128 AND 127 THEN 2 WHEN o_custkey BETWEEN -32768 AND 32767 THEN 3
  WHEN o_custkey BETWEEN -2147483648 AND 2147483647 THEN 5 ELSE 9 END + 1 + 2 AS BIGINT) AS bytes FROM orders""",
)
def dynamic_int_width(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    frames = encode.encode_rows(rows, ["c"])
    return frames.select("o_orderkey", F.octet_length("frame").cast("long").alias("bytes"))


@register("dynamic_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def dynamic_roundtrip(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    back = encode.decode_rows(encode.encode_rows(rows, rows.columns).select("frame"))
    items = F.from_json("json", "t string, v array<array<string>>")["v"]
    of = lambda i, kind: F.get_json_object(items[i][1], "$.v").cast(kind)
    return back.select(of(0, "long").alias("c_custkey"), of(1, "string").alias("c_name"), of(2, "double").alias("c_acctbal"))


@register(
    "string_ref_share",
    """SELECT conv_id, turn, CASE WHEN role = '' THEN 'EMPTY' WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 1 THEN 'REF' ELSE 'LITERAL' END AS mode FROM conversations""",
)
def string_ref_share(spark, sf_dir):
    return history.string_modes(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "mode")


@register(
    "shape_promotion",
    """WITH k AS (SELECT user_id, event_id, 'event_type,value,' || array_to_string(json_keys(props), ',') AS keys FROM events),
s AS (SELECT *, count(*) OVER (PARTITION BY user_id, keys ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM k)
SELECT user_id, event_id, keys, seen, seen >= 2 AND len(string_split(keys, ',')) >= 3 AS shaped FROM s""",
)
def shape_promotion(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit("event_type,value,"), F.array_join(F.json_object_keys("props"), ",")).alias("keys"))
    return history.shapes(rows, ["user_id"], ["event_id"], "keys")


_EVENT_FIELDS = ["event_type", "value", "props"]
_CHANGED = " + ".join(f"CAST({f} IS DISTINCT FROM lag({f}) OVER w AS INTEGER)" for f in _EVENT_FIELDS)


def _differences(spark, sf_dir):
    return history.differences(_table(spark, sf_dir, "events"), ["user_id"], ["event_id"], _EVENT_FIELDS)


@register(
    "patch_ratio",
    f"""SELECT user_id, event_id, row_number() OVER w = 1 AS "full", CASE WHEN row_number() OVER w = 1 THEN 0 ELSE {_CHANGED} END AS changed FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def patch_ratio(spark, sf_dir):
    return _differences(spark, sf_dir).select("user_id", "event_id", "full", "changed")


@register("patch_apply", "SELECT user_id, event_id, event_type, value, props FROM events")
def patch_apply(spark, sf_dir):
    return history.replay(_differences(spark, sf_dir), ["user_id"], ["event_id"], _EVENT_FIELDS)


@register(
    "template_mask",
    """WITH b AS (SELECT user_id % 4 AS source, event_id // 16 AS batch, list(event_type ORDER BY event_id) AS t, list(user_id ORDER BY event_id) AS u, count(*) AS n FROM events GROUP BY 1, 2)
SELECT source, batch, n, t IS DISTINCT FROM lag(t) OVER w AS changed_event_type, u IS DISTINCT FROM lag(u) OVER w AS changed_user_id FROM b WINDOW w AS (PARTITION BY source ORDER BY batch)""",
)
def template_mask(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr("user_id % 4 AS source", "event_id div 16 AS batch", "event_id", "event_type", "user_id")
    return history.template_masks(rows, ["source"], "batch", ["event_id"], ["event_type", "user_id"])


@register("varuint_size_hist", f"SELECT {_vs('l_partkey')} AS bytes, count(*) AS n FROM lineitem GROUP BY 1")
def varuint_size_hist(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy(S.varint_size(F.col("l_partkey")).alias("bytes")).agg(F.count("*").alias("n"))


@register(
    "fnv_dictionary_hash",
    """WITH RECURSIVE h AS (SELECT n_nationkey, hex(encode(n_name)) AS x, 0 AS i, CAST(14695981039346656037 AS HUGEINT) AS v FROM nation UNION ALL
SELECT n_nationkey, x, i + 1, (xor(v, CAST(('0x' || substring(x, 2 * i + 1, 2)) AS HUGEINT)) * 1099511628211) % 18446744073709551616 FROM h WHERE 2 * i < length(x))
SELECT n_nationkey, CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS hash FROM h WHERE 2 * i = length(x)""",
)
def fnv_dictionary_hash(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.encode("n_name", "UTF-8").alias("raw"))
    return encode.payload_hash(rows, "raw").select("n_nationkey", "hash")


for _name, _coder in (("rle", control.RLE), ("bitpack", control.BITPACK), ("huffman", control.HUFFMAN), ("fse", control.FSE)):
    @register(f"control_{_name}_roundtrip", "SELECT c_custkey, c_name || c_mktsegment AS text FROM customer")
    def _lane(spark, sf_dir, coder=_coder):
        rows = _table(spark, sf_dir, "customer").select("c_custkey", F.encode(F.concat("c_name", "c_mktsegment"), "UTF-8").alias("raw"))
        back = encode.decode_lanes(encode.code_lanes(rows, "raw", coder), "coded", coder)
        return back.select("c_custkey", F.decode("lane", "UTF-8").alias("text"))


@register(
    "byte_histogram",
    "SELECT CAST(('0x' || substring(h, 2 * k + 1, 2)) AS INTEGER) AS byte, count(*) AS n FROM (SELECT hex(encode(c_name)) AS h, unnest(range(0, strlen(c_name))) AS k FROM customer) GROUP BY 1",
)
def byte_histogram(spark, sf_dir):
    h = F.hex(F.encode("c_name", "UTF-8"))
    rows = _table(spark, sf_dir, "customer").select(h.alias("h"), F.explode(F.sequence(F.lit(0), F.octet_length("c_name") - 1)).alias("k"))
    code = F.conv(F.substr("h", F.col("k") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return rows.groupBy(code.alias("byte")).agg(F.count("*").alias("n"))


# Relational surface over the same tables: Catalyst's own operators.


@register(
    "rel_join_aggregate",
    """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def rel_join_aggregate(spark, sf_dir):
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # aggregate by customer before the joins: one row per key goes on
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    rows = per.join(customer, per.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("t"), 2).alias("total"))


@register("rel_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rel_rollup(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@register("rel_topk", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders) WHERE r <= 3")
def rel_topk(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r")).where("r <= 3")


@register("rel_semi_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS ordered FROM customer")
def rel_semi_anti(spark, sf_dir):
    customer, orders = _table(spark, sf_dir, "customer").select("c_custkey"), _table(spark, sf_dir, "orders")
    hit = orders.select(F.col("o_custkey").alias("c_custkey"))
    some = customer.join(hit, "c_custkey", "left_semi").withColumn("ordered", F.lit(True))
    return some.unionByName(customer.join(hit, "c_custkey", "left_anti").withColumn("ordered", F.lit(False)))


@register("rel_set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rel_set_operations(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k").intersect(_table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS k"))


@register("rel_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def rel_tumbling(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


@register(
    "rel_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k""",
)
def rel_sessions(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "ts")
    out = rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")



@register(
    "scored_codec",
    f"""SELECT block, least(plain_bytes, direct_bytes, delta_bytes, for_bytes, delta_for_bytes, delta_delta_bytes, rle_bytes) AS bytes FROM ({_sizes_sql(_ORDERS)})""",
)
def scored_codec(spark, sf_dir):
    """The least size over all codecs: choice by estimated size, without penalties."""
    sized = blocks.integer_sizes(_integers(spark, sf_dir, "orders"), ["block"], ["ord"], "v")
    return sized.select("block", F.least(*[c for c in sized.columns if c.endswith("_bytes")]).alias("bytes"))


@register(
    "snapshot_patch_choice",
    """WITH s AS (SELECT user_id, event_id, event_type, value, props, first_value(event_type) OVER w AS t, first_value(value) OVER w AS v, first_value(props) OVER w AS p,
  row_number() OVER w > 1 AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, CAST(CAST(event_type IS DISTINCT FROM t AS INTEGER) + CAST(value IS DISTINCT FROM v AS INTEGER) + CAST(props IS DISTINCT FROM p AS INTEGER) AS INTEGER) AS changed FROM s""",
)
def snapshot_patch_choice(spark, sf_dir):
    """Fields that differ from the oldest snapshot still kept (8 back)."""
    return history.against_snapshot(_table(spark, sf_dir, "events"), ["user_id"], ["event_id"], _EVENT_FIELDS, 8)


# Streaming twins: the same rows through keyed state.


def _events_stream(spark, sf_dir):
    # a file source reads folders or globs; the table may be either
    return run.stream_of(spark, f"{sf_dir}/events.parquet*").select("user_id", "event_id", "event_type", "value")


@register("stream_patch_roundtrip", "SELECT user_id, event_id, event_type, value FROM events")
def stream_patch_roundtrip(spark, sf_dir):
    fields = ["event_type", "value"]
    _, frames = run.drain(sessions.encode_stream(_events_stream(spark, sf_dir), "user_id", "event_id", fields))
    source = run.stream_of(spark, frames).select("user_id", "event_id", "part", "frame")
    got, _ = run.drain(sessions.decode_stream(source, "user_id", "event_id"))
    items = F.from_json("json", "t string, v array<array<string>>")["v"]
    of = lambda i, kind: F.get_json_object(items[i][1], "$.v").cast(kind)
    return got.select("user_id", "event_id", of(0, "string").alias("event_type"), of(1, "double").alias("value"))


@register("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_tumbling(spark, sf_dir):
    """Windows that the watermark has closed; beyond the format's own surface."""
    rows = run.stream_of(spark, f"{sf_dir}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"))
    counts = rows.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return run.drain(counts)[0].select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
