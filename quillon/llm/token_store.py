"""Content-addressed store of token ids.

Documents are encoded once.  A rolling hash over the ids (a gear hash of the
last 16 ids) cuts each document into chunks wherever the content, not the
position, says so; equal passages give equal chunks.  A chunk's address is the
digest of its bytes.  The store holds, in ascending doc_id order,

* a recipe per document: its start in the whole id stream, its number of ids,
  its chunks' addresses and sizes, and the Merkle root over the addresses;
* each distinct chunk's ids once, beside the recipe of its first document;
* a manifest: per bucket of documents the Merkle root over their roots, and one
  root over those of all buckets.

Reading back takes most chunks from the recipe's own row; only chunks that
several documents share are sent to the others.  Each chunk's digest and each
document's root are verified, and a mismatch raises.

Nulls: a null text is an empty document with the end id alone; a null doc_id
sorts first.  Ties of doc_id are ordered by their documents' roots.  Empty
tables give empty stores; repeated rows are stored as recipes over the same
chunks.  Texts of any length are encoded whole.  Only doc_id and text are read;
other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.arrow import begin_task, text_slices
from quillon.llm.byte_bpe import byte_bpe
from quillon.llm.common import Workspace, documents, tokenizer_file

END_ID = 0
#: Chunk sizes in ids: the mean comes from the mask of the rolling hash.
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 64, 9, 4096
WINDOW = 16
DIGEST = 16
#: Ids a bucket of documents should hold, and buckets at most: beyond that many
#: they grow.  A bucket is sorted on disk and streamed, so its size costs no memory.
BUCKET_IDS, MAX_BUCKETS = 8 << 20, 4096

ENCODED = "uid long, doc_id long, digest binary, n_tokens long, sizes array<int>, hashes binary, payload binary"
RECORD = (
    "bucket int, doc_id long, uid long, start long, n_tokens long, sizes array<int>, hashes binary, "
    "root binary, refs array<int>, shared array<int>, payload binary"
)


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd node moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        paired = [digest(a + b) for a, b in zip(level[::2], level[1::2])]
        level = paired + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def _gear(ids: np.ndarray) -> np.ndarray:
    """Mixed 64-bit value of each id (splitmix finaliser)."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW ids that end at each position, by doubling."""
    h, width = _gear(ids), 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return h


def cut_points(marks: np.ndarray, n: int) -> list[int]:
    """Chunk ends of a document of n ids whose hash marks lie at ``marks``."""
    ends, at, k = [], 0, 0
    while n - at > MAX_CHUNK or (k < len(marks) and n - at > MIN_CHUNK):
        while k < len(marks) and marks[k] + 1 - at < MIN_CHUNK:
            k += 1
        end = int(marks[k]) + 1 if k < len(marks) else n
        end = min(end, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes that hold every id of a vocabulary and the end id."""
    from tokenizers import Tokenizer

    largest = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    return 2 if largest < 1 << 16 else 4


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, encode_special_tokens: bool = False) -> DataFrame:
    """Chunked ids of every document."""
    width = id_width(tokenizer, end_id)

    def run(batches):
        encoder, kind = byte_bpe(tokenizer, encode_special_tokens=encode_special_tokens), f"<u{width}"
        mask = np.uint64((1 << MASK_BITS) - 1) << np.uint64(40)
        for whole in batches:
            for batch in text_slices(whole, limit=8 << 20):
                ids, bounds = encoder.encode_array(batch.column("text"))
                bounds = np.asarray(bounds)
                n = len(batch)
                ids = np.insert(ids, bounds[1:], end_id).astype(kind)
                bounds = bounds + np.arange(n + 1)
                marks = np.flatnonzero((rolling_hash(ids) & mask) == 0)
                first = np.searchsorted(marks, bounds)
                raw = ids.tobytes()
                sizes, offsets, hashes, whole_digests, payloads = [], [0], [], [], []
                for i in range(n):
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    payload = raw[lo * width : hi * width]
                    at, own = 0, []
                    for end in cut_points(marks[first[i] : first[i + 1]] - lo, hi - lo):
                        own.append(digest(payload[at * width : end * width]))
                        sizes.append(end - at)
                        at = end
                    offsets.append(len(sizes))
                    hashes.append(b"".join(own))
                    whole_digests.append(merkle_root(own))
                    payloads.append(payload)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(whole_digests, pa.binary()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sizes, pa.int32())),
                        pa.array(hashes, pa.binary()),
                        pa.array(payloads, pa.binary()),
                    ],
                    ["doc_id", "digest", "n_tokens", "sizes", "hashes", "payload"],
                )

    fields = ENCODED.replace("uid long, ", "")
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)
    return coded.select(F.monotonically_increasing_id().alias("uid"), "*")


def _chunk_rows(coded: DataFrame) -> DataFrame:
    each = F.expr(f"transform(sequence(1, size(sizes)), i -> substring(hashes, i * {DIGEST} - {DIGEST - 1}, {DIGEST}))")
    return coded.select("uid", "doc_id", "digest", F.posexplode(each).alias("idx", "hash"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, bucket_ids: int = BUCKET_IDS, encode_special_tokens: bool = False) -> dict:
    """Writes the store to ``path`` and returns its totals; special tokens are
    recognised as the library does by default, or with ``encode_special_tokens``
    encoded as plain text."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "token_store")
    coded = work.table(encode(docs, tokenizer, end_id, encode_special_tokens), "coded")
    total = coded.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n_buckets = min(MAX_BUCKETS, max(1, -(-total[1] // bucket_ids)))
    edges = []
    if n_buckets > 1:
        shares = [i / n_buckets for i in range(1, n_buckets)]
        edges = sorted(set(coded.agg(F.percentile_approx("doc_id", shares, 20 * n_buckets)).first()[0] or []))
    # bucket = how many edges lie below the doc_id; a null doc_id comes first
    below = F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in edges]), lambda e: e < F.col("doc_id"))) if edges else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(below).cast("int")
    sums = coded.groupBy(bucket.alias("bucket")).agg(F.sum("n_tokens")).collect()  # at most MAX_BUCKETS rows
    starts, at = {}, 0
    for b, n in sorted(map(tuple, sums)):
        starts[b], at = at, at + n

    # A chunk belongs to the first document that holds it; the rest refer to it.
    seen = _chunk_rows(coded)
    place = F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "digest", "uid", "idx")
    owners = seen.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = seen.join(owners, "hash").select(
        "uid", "doc_id", "digest", "idx", ((F.col("first.uid") == F.col("uid")) & (F.col("first.idx") == F.col("idx"))).alias("own")
    )
    notes = repeats.groupBy("uid", "doc_id", "digest").agg(
        F.array_sort(F.collect_list(F.when(~F.col("own"), F.col("idx")))).alias("refs"),
        F.array_sort(F.collect_list(F.when(F.col("own"), F.col("idx")))).alias("shared"),
    )
    empty = F.array().cast("array<int>")
    rows = coded.select(bucket.alias("bucket"), "doc_id", "digest", "uid", F.lit(1).alias("tag"), "n_tokens", "sizes", "hashes", "payload", empty.alias("refs"), empty.alias("shared"))
    side = notes.select(bucket.alias("bucket"), "doc_id", "digest", "uid", F.lit(0).alias("tag"), F.lit(0).cast("long").alias("n_tokens"), empty.alias("sizes"), F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("payload"), "refs", "shared")
    dealt = rows.unionByName(side).repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "doc_id", "digest", "uid", "tag")

    def compact(batches):
        begin_task()
        bucket_now, start, note = None, 0, {}
        for batch in batches:
            tags = batch.column("tag").to_numpy()
            uids = batch.column("uid").to_pylist()
            for i in np.flatnonzero(tags == 0).tolist():
                note[uids[i]] = (batch.column("refs")[i].as_py(), batch.column("shared")[i].as_py())
            rows = batch.take(pa.array(np.flatnonzero(tags == 1)))
            if not len(rows):
                continue
            starts_of = []
            for b, n in zip(rows.column("bucket").to_pylist(), rows.column("n_tokens").to_pylist()):
                if b != bucket_now:
                    bucket_now, start = b, starts[b]
                starts_of.append(start)
                start += n
            uids = rows.column("uid").to_pylist()
            refs, shared = zip(*[note.pop(u, ((), ())) for u in uids])
            payload = rows.column("payload").to_pylist()
            for i, gone in enumerate(refs):
                if gone:
                    gone, sizes = set(gone), rows.column("sizes")[i].as_py()
                    width = len(payload[i]) // sum(sizes)
                    ends = [0, *(np.cumsum(sizes) * width).tolist()]
                    payload[i] = b"".join(payload[i][ends[k] : ends[k + 1]] for k in range(len(sizes)) if k not in gone)
            columns = {
                "start": pa.array(starts_of, pa.int64()), "root": rows.column("digest"),
                "refs": pa.array(refs, pa.list_(pa.int32())), "shared": pa.array(shared, pa.list_(pa.int32())), "payload": pa.array(payload, pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else rows.column(c) for c in RECORD_NAMES], RECORD_NAMES)

    dealt.mapInArrow(compact, RECORD).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/records")
    work.drop("coded")
    if total[0]:
        _roots(spark.read.schema(RECORD).parquet(f"{path}/records")).write.parquet(f"{path}/manifest")
        whole = _whole_root(spark.read.schema(MANIFEST).parquet(f"{path}/manifest"))
        spark.createDataFrame([whole], ROOT).coalesce(1).write.parquet(f"{path}/root")
    return {"documents": total[0], "ids": total[1], "buckets": n_buckets}


MANIFEST = "bucket int, documents long, ids long, root binary"
ROOT = "documents long, ids long, root binary"
RECORD_NAMES = [f.split()[0] for f in RECORD.split(", ")]


def _whole_root(manifest: DataFrame) -> tuple[int, int, bytes]:
    """Documents, ids and the root over all buckets in order."""
    rows = sorted(tuple(r) for r in manifest.select("bucket", "documents", "ids", "root").collect())  # at most MAX_BUCKETS
    return sum(r[1] for r in rows), sum(r[2] for r in rows), merkle_root([bytes(r[3]) for r in rows])


def _roots(records: DataFrame) -> DataFrame:
    """Per bucket: counts, and the Merkle root over its documents' roots in order."""
    rows = records.select("bucket", "start", "uid", "n_tokens", "root").repartition("bucket").sortWithinPartitions("bucket", "start", "uid")

    def fold(batches):
        now, roots, ids = None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and r["bucket"] != now:
                    yield _row(now, roots, ids)
                    roots, ids = [], 0
                now = r["bucket"]
                roots.append(r["root"])
                ids += r["n_tokens"]
        if now is not None:
            yield _row(now, roots, ids)

    def _row(bucket, roots, ids):
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([len(roots)]), pa.array([ids]), pa.array([merkle_root(roots)], pa.binary())],
            ["bucket", "documents", "ids", "root"],
        )

    return rows.mapInArrow(fold, MANIFEST)


def verify(spark: SparkSession, path: str) -> None:
    """Raises unless the manifest holds for the recipes in the store."""
    kept = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    now = _roots(spark.read.schema(RECORD).parquet(f"{path}/records"))
    wrong = kept.exceptAll(now).unionByName(now.exceptAll(kept)).limit(1).collect()
    if wrong:
        raise ValueError(f"manifest mismatch in bucket {wrong[0]['bucket']}")
    stored = spark.read.schema(ROOT).parquet(f"{path}/root").first()
    if stored is None or _whole_root(kept) != (stored["documents"], stored["ids"], bytes(stored["root"])):
        raise ValueError("the manifest does not match the store's root")


def _rebuild(record: dict, fetched: dict[int, bytes]) -> bytes:
    """The ids of a document, each chunk's digest and the root verified."""
    sizes, refs = record["sizes"], set(record["refs"])
    leaves = [record["hashes"][i : i + DIGEST] for i in range(0, len(record["hashes"]), DIGEST)]
    own_ids = sum(s for i, s in enumerate(sizes) if i not in refs)
    width = len(record["payload"]) // own_ids if own_ids else None
    parts, at = [], 0
    for i, (leaf, size) in enumerate(zip(leaves, sizes)):
        if i in refs:
            part = fetched[i]
        else:
            part = record["payload"][at : at + size * width]
            at += size * width
        if digest(part) != leaf:
            raise ValueError(f"chunk {leaf.hex()} of document {record['doc_id']} is damaged")
        parts.append(part)
    if merkle_root(leaves) != record["root"]:
        raise ValueError(f"recipe of document {record['doc_id']} is damaged")
    return b"".join(parts)


READ = "doc_id long, start long, n_tokens long, ids binary"
SUMMARY = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """Documents from the store: ids as unsigned 32-bit little-endian, or with
    ``digest_only`` their crc32 in place of the ids."""
    records = spark.read.schema(RECORD).parquet(f"{path}/records")

    def emit(rows):
        docs, starts, counts, last = [], [], [], []
        for r, ids in rows:
            wide = np.frombuffer(ids, dtype=f"<u{len(ids) // max(r['n_tokens'], 1) or 2}").astype("<u4").tobytes()
            if len(wide) != 4 * r["n_tokens"]:
                raise ValueError(f"document {r['doc_id']} has {len(wide) // 4} ids, not {r['n_tokens']}")
            docs.append(r["doc_id"])
            starts.append(r["start"])
            counts.append(r["n_tokens"])
            last.append(zlib.crc32(wide) if digest_only else wide)
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(last, pa.int64() if digest_only else pa.binary())],
            ["doc_id", "start", "n_tokens", "ids_crc32" if digest_only else "ids"],
        )

    def alone(batches):
        begin_task()
        for batch in batches:
            yield emit((r, _rebuild(r, {})) for r in batch.to_pylist())

    def published(batches):
        begin_task()
        for batch in batches:
            hashes, parts = [], []
            for r in batch.to_pylist():
                shared, refs, at = set(r["shared"]), set(r["refs"]), 0
                own_ids = sum(s for i, s in enumerate(r["sizes"]) if i not in refs)
                width = len(r["payload"]) // own_ids
                for i, size in enumerate(r["sizes"]):
                    if i in refs:
                        continue
                    if i in shared:
                        hashes.append(r["hashes"][i * DIGEST : (i + 1) * DIGEST])
                        parts.append(r["payload"][at : at + size * width])
                    at += size * width
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(parts, pa.binary())], ["hash", "part"])

    def together(batches):
        begin_task()
        fetched = {}
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["tag"] == 0:
                    fetched[r["idx"]] = r["part"]
                else:
                    done.append((r, _rebuild(r, fetched)))
                    fetched = {}
            if done:
                yield emit(done)

    schema = SUMMARY if digest_only else READ
    local = records.where(F.size("refs") == 0).select("doc_id", "start", "n_tokens", "sizes", "hashes", "root", "refs", "payload")
    shares = records.where(F.size("shared") > 0).select("sizes", "hashes", "refs", "shared", "payload").mapInArrow(published, "hash binary, part binary")
    asking = records.where(F.size("refs") > 0)
    wanted = asking.select("uid", F.explode("refs").alias("idx"), "hashes").select("uid", "idx", F.expr(f"substring(hashes, idx * {DIGEST} + 1, {DIGEST})").alias("hash"))
    sent = wanted.join(shares, "hash").select("uid", "idx", "part")
    none = F.lit(None)
    left = sent.select("uid", F.lit(0).alias("tag"), "idx", "part", *[none.cast(t).alias(c) for c, t in (("doc_id", "long"), ("start", "long"), ("n_tokens", "long"), ("sizes", "array<int>"), ("hashes", "binary"), ("root", "binary"), ("refs", "array<int>"), ("payload", "binary"))])
    right = asking.select("uid", F.lit(1).alias("tag"), none.cast("int").alias("idx"), none.cast("binary").alias("part"), "doc_id", "start", "n_tokens", "sizes", "hashes", "root", "refs", "payload")
    joined = left.unionByName(right).repartition("uid").sortWithinPartitions("uid", "tag")
    return local.mapInArrow(alone, schema).unionByName(joined.mapInArrow(together, schema))


def op1_token_store(spark, sf_dir):
    work = Workspace(spark, "op1")
    path = work.path("store")
    if not write(documents(spark, sf_dir), path, tokenizer_file("byte_bpe_50k.json"))["documents"]:
        return spark.createDataFrame([], SUMMARY)
    verify(spark, path)
    return read(spark, path, digest_only=True)
