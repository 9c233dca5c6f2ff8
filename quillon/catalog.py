"""Registry of the engine's queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import blocks, logical
from quillon.plans import selection

BLOCK = 1024


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("v"))


def _blocked(df, key, value, size=BLOCK):
    return df.select(F.expr(f"{key} div {size}").alias("block"), F.col(key).alias("ord"), F.col(value).alias("v"))


#: name -> (table, key, value expression for both engines): the integer columns.
INTEGERS = {
    "events": ("events", "event_id", "user_id"),
    "orders": ("orders", "o_orderkey", "o_custkey"),
    "part": ("part", "p_partkey", "p_size"),
    "keys": ("orders", "o_orderkey", "o_orderkey"),
}


def _integers(spark, sf_dir, name):
    table, key, value = INTEGERS[name]
    return _blocked(_table(spark, sf_dir, table), key, value)


def _sql_base(name):
    table, key, value = INTEGERS[name]
    return f"SELECT {key} // {BLOCK} AS block, {key} AS ord, CAST({value} AS BIGINT) AS v FROM {table}"


def _bits(x):
    return f"length(bin({x}))"


def _vs(x):
    return f"CAST(ceil({_bits(x)} / 7.0) AS BIGINT)"


def _zz(x):
    return f"(CASE WHEN {x} >= 0 THEN 2 * CAST({x} AS HUGEINT) ELSE -2 * CAST({x} AS HUGEINT) - 1 END)"


def _ubits(x):
    """Bits of a non-negative HUGEINT below 2**64, at least 1."""
    return f"length(bin(CAST({x} AS UBIGINT)))"


def _uvs(x):
    return f"CAST(ceil({_ubits(x)} / 7.0) AS BIGINT)"


def _packed(n, widest):
    return f"(CASE WHEN {n} = 0 THEN 2 ELSE {_vs(n)} + 1 + CAST(ceil({n} * {widest} / 8.0) AS BIGINT) END)"


def _stat_rows(base):
    return f"""base AS ({base}),
lagged AS (SELECT *, lag(v) OVER w AS prev, lead(v) OVER w AS nxt, row_number() OVER w - 1 AS i FROM base WINDOW w AS (PARTITION BY block ORDER BY ord)),
first_d AS (SELECT *, CASE WHEN i = 0 THEN v ELSE v - prev END AS d FROM lagged),
rows_d AS (SELECT *, CASE WHEN i > 0 THEN d - lag(d) OVER (PARTITION BY block ORDER BY ord) END AS dd FROM first_d)"""


def _stats_sql(base):
    return f"""WITH {_stat_rows(base)},
stats AS (SELECT block, count(*) AS n, min(v) AS min_v, max(v) AS max_v,
  CAST({_bits('max(v) - min(v)')} AS BIGINT) AS range_bits,
  sum(CASE WHEN dd <> 0 THEN 1 ELSE 0 END)::DOUBLE / greatest(count(*) - 1, 1) AS nonzero_dd_ratio,
  CAST({_bits('max(d) - min(d)')} AS BIGINT) AS delta_range_bits,
  sum(CASE WHEN v = prev OR v = nxt THEN 1 ELSE 0 END)::DOUBLE / count(*) AS repeated_ratio,
  count(*)::DOUBLE / sum(CASE WHEN v = prev THEN 0 ELSE 1 END) AS avg_run,
  bool_and(coalesce(v >= prev, true)) AS monotonic,
  CAST(max({_bits('abs(d)')}) AS BIGINT) AS max_abs_delta_bits, CAST(max({_bits('abs(v)')}) AS BIGINT) AS max_abs_bits
  FROM rows_d GROUP BY block)
"""


_CHOICE = """CASE WHEN n < 4 THEN 'PLAIN' WHEN n >= 8 AND (nonzero_dd_ratio <= 0.25 OR delta_range_bits <= 2) THEN 'DELTA_DELTA_BITPACK'
  WHEN repeated_ratio >= 0.5 AND avg_run >= 3.0 THEN 'RLE' WHEN range_bits <= 60 THEN 'FOR_BITPACK'
  WHEN n >= 8 AND monotonic AND delta_range_bits <= range_bits - 3 THEN 'DELTA_FOR_BITPACK' WHEN max_abs_delta_bits <= 61 THEN 'DELTA_BITPACK'
  WHEN n >= 8 AND max_abs_bits <= 16 AND NOT monotonic THEN 'SIMPLE8B' WHEN max_abs_bits < 64 THEN 'DIRECT_BITPACK' ELSE 'PLAIN' END"""


def _sizes_sql(base):
    z = _zz
    return f"""WITH {_stat_rows(base)},
extra AS (SELECT *, min(v) OVER (PARTITION BY block) AS lo, min(d) OVER (PARTITION BY block) AS dlo,
  sum(CASE WHEN v = prev THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM rows_d),
runs AS (SELECT block, run, count(*) AS len, any_value(v) AS rv FROM extra GROUP BY block, run),
rle AS (SELECT block, {_vs('count(*)')} + sum({_uvs(z('rv'))} + {_vs('len')}) AS rle_bytes FROM runs GROUP BY block),
sized AS (SELECT block, count(*) AS n, {_vs('count(*)')} + sum({_uvs(z('v'))}) AS plain_bytes,
  {_packed('count(*)', f"max({_ubits(z('v'))})")} AS direct_bytes, {_packed('count(*)', f"max({_ubits(z('d'))})")} AS delta_bytes,
  {_uvs(z('min(v)'))} + {_packed('count(*)', f"max({_ubits(z('v - lo'))})".replace('v - lo', '(v - lo)'))} AS for_bytes,
  {_uvs(z('min(d)'))} + {_packed('count(*)', f"max({_ubits(z('(d - dlo)'))})")} AS delta_for_bytes,
  {_vs('count(*)')} + {_uvs(z('max(CASE WHEN i = 0 THEN v END)'))} + CASE WHEN count(*) > 1 THEN {_uvs(z('max(CASE WHEN i = 1 THEN d END)'))}
    + {_packed('count(CASE WHEN i >= 2 THEN dd END)', f"coalesce(max(CASE WHEN i >= 2 THEN {_ubits(z('dd'))} END), 1)")} ELSE 0 END AS delta_delta_bytes
  FROM extra GROUP BY block)
SELECT block, n, CAST(plain_bytes AS BIGINT) AS plain_bytes, CAST(direct_bytes AS BIGINT) AS direct_bytes, CAST(delta_bytes AS BIGINT) AS delta_bytes,
  CAST(for_bytes AS BIGINT) AS for_bytes, CAST(delta_for_bytes AS BIGINT) AS delta_for_bytes, CAST(delta_delta_bytes AS BIGINT) AS delta_delta_bytes,
  CAST(rle_bytes AS BIGINT) AS rle_bytes FROM sized JOIN rle USING (block)"""


QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


for _name in INTEGERS:
    register(f"profile_int_blocks_{_name}" if _name != "events" else "profile_int_blocks", _stats_sql(_sql_base(_name)) + f"SELECT *, {_CHOICE} AS codec FROM stats")(
        lambda spark, sf_dir, n=_name: blocks.integer_codec(_integers(spark, sf_dir, n), ["block"], ["ord"], "v")
    )
    register(f"size_int_codecs_{_name}", _sizes_sql(_sql_base(_name)))(
        lambda spark, sf_dir, n=_name: blocks.integer_sizes(_integers(spark, sf_dir, n), ["block"], ["ord"], "v")
    )

register(
    "select_codec_unsigned",
    _stats_sql(_sql_base("orders")) + f"SELECT block, n, CASE WHEN c IN ('RLE', 'FOR_BITPACK', 'SIMPLE8B', 'DIRECT_BITPACK', 'PLAIN') THEN c ELSE 'DIRECT_BITPACK' END AS codec FROM (SELECT block, n, {_CHOICE} AS c FROM stats)",
)(lambda spark, sf_dir: blocks.integer_codec(_integers(spark, sf_dir, "orders"), ["block"], ["ord"], "v", unsigned=True).select("block", "n", "codec"))


@register(
    "select_codec_float",
    f"""WITH b AS (SELECT event_id // {BLOCK} AS block, event_id AS ord, value::DOUBLE::BIT::BIGINT AS b FROM events),
x AS (SELECT *, xor(b, lag(b) OVER (PARTITION BY block ORDER BY ord)) AS x FROM b),
s AS (SELECT block, count(*) AS n, sum(CASE WHEN bit_count(x) <= 1 THEN 1 ELSE 0 END)::DOUBLE / greatest(count(*) - 1, 1) AS near_ratio,
  coalesce(avg(CASE WHEN x <> 0 THEN CASE WHEN x < 0 THEN 64 ELSE {_bits('x')} END END), 0.0) AS mean_xor_bits,
  CAST({_vs('count(*)')} + 8 * count(*) AS BIGINT) AS plain_bytes FROM x GROUP BY block)
SELECT *, CASE WHEN n >= 4 AND near_ratio >= 0.5 AND mean_xor_bits <= 16.0 THEN 'XOR_FLOAT' ELSE 'PLAIN' END AS codec FROM s""",
)
def select_codec_float(spark, sf_dir):
    stats = blocks.float_statistics(_blocked(_table(spark, sf_dir, "events"), "event_id", "value"), ["block"], ["ord"], "v")
    return stats.withColumn("codec", selection.float_codec(F.col)).drop("xor_bytes")


_LCP = """coalesce(list_min(list_filter(range(0, least(strlen(s), strlen(prev))), lambda k: substring(hex(encode(s)), 2 * k + 1, 2) <> substring(hex(encode(prev)), 2 * k + 1, 2))), least(strlen(s), strlen(prev)))"""

#: name -> (table, key, value): the string columns.
STRINGS = {"priority": ("orders", "o_orderkey", "o_orderpriority"), "customer": ("customer", "c_custkey", "c_name"), "brand": ("part", "p_partkey", "p_brand"), "lang": ("documents", "doc_id", "lang")}


def _strings_sql(name):
    table, key, value = STRINGS[name]
    return f"""WITH base AS (SELECT {key} // {BLOCK} AS block, {key} AS ord, {value} AS s FROM {table}),
a AS (SELECT *, lag(s) OVER w AS prev, row_number() OVER w AS i FROM base WINDOW w AS (PARTITION BY block ORDER BY ord)),
b AS (SELECT *, CASE WHEN prev IS NOT NULL THEN {_LCP} END AS lcp, min(i) OVER (PARTITION BY block, s) AS first_i FROM a),
c AS (SELECT *, dense_rank() OVER (PARTITION BY block ORDER BY first_i) - 1 AS id, strlen(s) AS size FROM b),
t AS (SELECT block, count(*) AS n, CAST(sum(CASE WHEN i = first_i THEN 1 ELSE 0 END) AS BIGINT) AS n_unique,
  sum(CASE WHEN lcp >= 3 THEN 1 ELSE 0 END)::DOUBLE / greatest(count(*) - 1, 1) AS prefix_ratio,
  CAST({_vs('count(*)')} + sum({_vs('size')} + size) AS BIGINT) AS plain_bytes,
  CAST({_vs('CAST(sum(CASE WHEN i = first_i THEN 1 ELSE 0 END) AS BIGINT)')} + sum(CASE WHEN i = first_i THEN {_vs('size')} + size ELSE 0 END) + {_vs('count(*)')} + sum({_vs('id')}) AS BIGINT) AS dictionary_bytes,
  CAST({_vs('count(*)')} + sum(CASE WHEN lcp IS NULL THEN {_vs('size')} + size ELSE {_vs('lcp')} + {_vs('size - lcp')} + size - lcp END) AS BIGINT) AS prefix_bytes
  FROM c GROUP BY block)
SELECT *, n_unique::DOUBLE / n AS unique_ratio, CASE WHEN n < 4 THEN 'PLAIN' WHEN prefix_ratio >= 0.5 THEN 'PREFIX_DELTA'
  WHEN n >= 16 AND n_unique::DOUBLE / n <= 0.25 THEN 'DICTIONARY' WHEN n_unique < n THEN 'STRING_REF' ELSE 'PLAIN' END AS codec FROM t"""


def _strings(spark, sf_dir, name):
    table, key, value = STRINGS[name]
    return _blocked(_table(spark, sf_dir, table), key, value)


for _name in STRINGS:
    register(f"select_codec_string_{_name}", _strings_sql(_name))(
        lambda spark, sf_dir, n=_name: blocks.string_statistics(_strings(spark, sf_dir, n), ["block"], ["ord"], "v").withColumn("codec", selection.string_codec(F.col))
    )


@register(
    "profile_null_strategy",
    """WITH j AS (SELECT d.doc_id // 128 AS block, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
t AS (SELECT block, 'quality' AS field, count(*) AS n, count(*) - count(quality) AS nulls FROM j GROUP BY block
  UNION ALL SELECT block, 'toxic', count(*), count(*) - count(toxic) FROM j GROUP BY block)
SELECT *, CASE WHEN nulls = 0 THEN 'ALL_PRESENT_ELIDED' WHEN nulls <= n // 4 THEN 'INVERTED_PRESENCE_BITMAP' ELSE 'PRESENCE_BITMAP' END AS null_strategy FROM t""",
)
def profile_null_strategy(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = docs.select("doc_id").join(labels, "doc_id", "left").withColumn("block", F.expr("doc_id div 128"))
    counts = rows.groupBy("block").agg(F.count("*").alias("n"), *[(F.count("*") - F.count(c)).alias(c) for c in ("quality", "toxic")])
    long = counts.unpivot(["block", "n"], ["quality", "toxic"], "field", "nulls")
    return long.withColumn("null_strategy", selection.null_strategy(F.col("n"), F.col("nulls")))


@register("delta_encode", f"SELECT block, ord, v - coalesce(lag(v) OVER (PARTITION BY block ORDER BY ord), 0) AS delta FROM ({_sql_base('orders')})")
def delta_encode(spark, sf_dir):
    return logical.delta(_integers(spark, sf_dir, "orders"), ["block"], ["ord"], "v").drop("v")


@register("delta_roundtrip", f"SELECT block, ord, v AS value FROM ({_sql_base('orders')})")
def delta_roundtrip(spark, sf_dir):
    return logical.undelta(delta_encode(spark, sf_dir), ["block"], ["ord"]).drop("delta")


_TS = f"SELECT event_id // {BLOCK} AS block, event_id AS ord, epoch_us(ts) AS v FROM events"


def _times(spark, sf_dir):
    return _blocked(_micros(spark, sf_dir), "event_id", "v")


@register(
    "delta_delta_encode",
    f"""SELECT block, ord, CASE WHEN lag(v, 1) OVER w IS NULL THEN v WHEN lag(v, 2) OVER w IS NULL THEN v - lag(v) OVER w
  ELSE v - 2 * lag(v) OVER w + lag(v, 2) OVER w END AS dd FROM ({_TS}) WINDOW w AS (PARTITION BY block ORDER BY ord)""",
)
def delta_delta_encode(spark, sf_dir):
    return logical.delta_delta(_times(spark, sf_dir), ["block"], ["ord"], "v").drop("v")


@register("delta_delta_roundtrip", f"SELECT block, ord, v AS value FROM ({_TS})")
def delta_delta_roundtrip(spark, sf_dir):
    return logical.undelta_delta(delta_delta_encode(spark, sf_dir), ["block"], ["ord"]).drop("dd")


@register("for_encode", f"SELECT block, ord, min(v) OVER (PARTITION BY block) AS base, v - min(v) OVER (PARTITION BY block) AS \"offset\" FROM ({_sql_base('part')})")
def for_encode(spark, sf_dir):
    return logical.frame_of_reference(_integers(spark, sf_dir, "part").withColumn("v", F.col("v").cast("long")), ["block"], "v").drop("v")


_PATCH_SQL = f"""WITH o AS (SELECT block, ord, v - min(v) OVER (PARTITION BY block) AS x, min(v) OVER (PARTITION BY block) AS base FROM ({_sql_base('orders')})),
w AS (SELECT *, greatest({_bits('max(x) OVER (PARTITION BY block)')} - 2, 0) AS bw FROM o)
SELECT block, ord, base, CAST(CASE WHEN {_bits('x')} > bw THEN x & ((1::BIGINT << bw) - 1) ELSE x END AS BIGINT) AS main, CASE WHEN {_bits('x')} > bw THEN x END AS patch FROM w"""


@register("patched_for_encode", _PATCH_SQL)
def patched_for_encode(spark, sf_dir):
    return logical.patched_frame(_integers(spark, sf_dir, "orders"), ["block"], "v").select("block", "ord", "base", "main", "patch")


@register("patched_for_roundtrip", f"SELECT block, ord, v AS value FROM ({_sql_base('orders')})")
def patched_for_roundtrip(spark, sf_dir):
    return logical.unpatch(patched_for_encode(spark, sf_dir)).select("block", "ord", "value")


_STATUS = f"SELECT o_orderkey // {BLOCK} AS block, o_orderkey AS ord, o_orderstatus AS v FROM orders"


def _status(spark, sf_dir):
    return _blocked(_table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus")


@register(
    "rle_runs",
    f"""WITH m AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY block ORDER BY ord) THEN 0 ELSE 1 END AS s FROM ({_STATUS})),
r AS (SELECT *, sum(s) OVER (PARTITION BY block ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT block, CAST(run AS BIGINT) AS run, any_value(v) AS v, count(*) AS length FROM r GROUP BY block, run""",
)
def rle_runs(spark, sf_dir):
    return logical.runs(_status(spark, sf_dir), ["block"], ["ord"], "v")


@register("rle_roundtrip", f"SELECT block, row_number() OVER (PARTITION BY block ORDER BY ord) - 1 AS place, v FROM ({_STATUS})")
def rle_roundtrip(spark, sf_dir):
    return logical.expand_runs(rle_runs(spark, sf_dir), ["block"], "v")


_PRIORITY = f"SELECT o_orderkey // {BLOCK} AS block, o_orderkey AS ord, o_orderpriority AS v FROM orders"


@register(
    "dict_first_seen",
    f"SELECT block, v, uses, CAST(row_number() OVER (PARTITION BY block ORDER BY f) - 1 AS INTEGER) AS id FROM (SELECT block, v, count(*) AS uses, min(ord) AS f FROM ({_PRIORITY}) GROUP BY block, v)",
)
def dict_first_seen(spark, sf_dir):
    return logical.dictionary_first_seen(_strings(spark, sf_dir, "priority"), ["block"], ["ord"], "v")


@register(
    "dict_sorted",
    f"SELECT block, v, uses, CAST(row_number() OVER (PARTITION BY block ORDER BY v) - 1 AS INTEGER) AS id FROM (SELECT block, v, count(*) AS uses FROM ({_PRIORITY}) GROUP BY block, v)",
)
def dict_sorted(spark, sf_dir):
    return logical.dictionary_sorted(_strings(spark, sf_dir, "priority"), ["block"], "v")


@register(
    "dict_encode",
    f"""WITH d AS (SELECT block, v, CAST(row_number() OVER (PARTITION BY block ORDER BY f) - 1 AS INTEGER) AS id FROM (SELECT block, v, min(ord) AS f FROM ({_PRIORITY}) GROUP BY block, v))
SELECT block, ord, id FROM ({_PRIORITY}) JOIN d USING (block, v)""",
)
def dict_encode(spark, sf_dir):
    return logical.intern(_strings(spark, sf_dir, "priority"), ["block"], ["ord"], "v").select("block", "ord", "id")


@register(
    "prefix_delta",
    f"""WITH a AS (SELECT c_custkey // {BLOCK} AS block, c_custkey AS ord, c_name AS s, lag(c_name) OVER (PARTITION BY c_custkey // {BLOCK} ORDER BY c_custkey) AS prev FROM customer),
b AS (SELECT *, CASE WHEN prev IS NULL THEN 0 ELSE {_LCP} END AS kept FROM a)
SELECT block, ord, CAST(kept AS INTEGER) AS kept, substring(s, kept + 1) AS suffix FROM b""",
)
def prefix_delta(spark, sf_dir):
    return logical.prefix_delta(_strings(spark, sf_dir, "customer"), ["block"], ["ord"], "v").drop("v")


@register(
    "xor_encode",
    f"""SELECT block, ord, xor(b, coalesce(lag(b) OVER (PARTITION BY block ORDER BY ord), 0)) AS xor FROM
  (SELECT event_id // {BLOCK} AS block, event_id AS ord, value::DOUBLE::BIT::BIGINT AS b FROM events)""",
)
def xor_encode(spark, sf_dir):
    rows = blocks.with_bits(_blocked(_table(spark, sf_dir, "events"), "event_id", "value"), "v", "bits")
    return logical.xor_previous(rows, ["block"], ["ord"], "bits").select("block", "ord", "xor")


@register("xor_roundtrip", f"SELECT event_id // {BLOCK} AS block, event_id AS ord, value::DOUBLE::BIT::BIGINT AS bits FROM events")
def xor_roundtrip(spark, sf_dir):
    return logical.unxor(xor_encode(spark, sf_dir), ["block"], ["ord"]).drop("xor")


@register("snapshot_retention", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8")
def snapshot_retention(spark, sf_dir):
    return logical.retain_last(_table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])
