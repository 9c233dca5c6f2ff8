"""N-gram Jaccard join: a size-aware heavy-light join over shingle sets.

A document's set holds its distinct word shingles.  Documents with equal sets
form one class; links are sought between classes.  Sets up to a boundary size
enumerate the subsets of each size that an intersection may have, and meet in
an equal subset.  Larger sets scan inverted lists: with a common order of
shingles, rare ones first, linked sets share one of their first few shingles,
so only the lists of those are built.  The boundary is the size at which
enumerating costs more rows than scanning, from the histogram of small sizes
and the mean list length.

Each set has a parity sketch of about as many bits as it has shingles: a bit
says whether an odd number of shingles falls on it.  Sketches differ in no more
bits than sets differ in shingles, so pairs whose sketches differ too much are
dropped before any set is moved, and no link with them.

Meeting places of few sets give pairs; crowded ones are thinned by the sketches
in one task, and give pairs too unless most of their sets may link.  Pairs are
verified by their sets; the places left get the sets themselves and count
intersections by inverted lists inside one task, joining groups as they go,
without listing pairs.  Every link is verified exactly on 64-bit shingle hashes.

The common order comes from counters of fixed size (``COUNTERS``), filled from
all documents; any order is right, a better one only makes lists shorter.

Nulls and texts without words have an empty set, link with nothing and are
their own component; a null doc_id stays null.  Repeated rows are equal sets.
Ties of a component are decided by the smallest doc_id, then row key.  Texts of
any length are taken whole.  Columns of any name are carried along by
``keep_one``; ``join`` reads doc_id and text only.  Empty tables give empty
results.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import begin_task, string_bytes, text_slices
from quillon.llm.common import Workspace, components, documents, own_names
from quillon.llm.line_dedup import _bounds, _groups, bit_filter, hits, large_strings, mix, spots, string_hashes

WIDTH = 5
PERCENT = 80
COUNTERS = 1 << 20
PART = 1 << 14  # counters per shuffled row
SMALL = 40  # sizes that the boundary may be chosen among
CROWD = 32  # sets at one meeting place beyond which no pairs are listed
DENSE = 8  # pairs a set, in the mean, beyond which a crowded place stays one
SKETCH = 64  # least bits of a sketch

ROW_KEY = "xxhash64(doc_id, text)"

#: A-Z in lower case, all other bytes as they are.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text."""
    # not pc.ascii_lower: it misreads an array whose first offset is not 0, as
    # the cast makes of every slice but the first
    data, bounds = string_bytes(pc.fill_null(texts, "").cast(pa.large_string()))
    texts = large_strings(_LOWER[data], bounds)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[real]
    coded = words.filter(pa.array(real)).dictionary_encode()
    h = string_hashes(coded.dictionary)[coded.indices.to_numpy()]
    n_words = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(n_words) - n_words
    grams = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(grams)]
    grams = mix(grams)
    for lo, n in zip(begin.tolist(), n_words.tolist()):
        if n >= width:
            yield np.unique(grams[lo : lo + n - width + 1])
        elif n:
            total = np.array([n], dtype=np.uint64)
            for x in h[lo : lo + n]:
                total = mix(total * np.uint64(31) + x)
            yield total
        else:
            yield np.zeros(0, dtype=np.uint64)


def slack(size: int, percent: int) -> int:
    """How many shingles of a set may be missing from a linked set."""
    return size - -(-percent * size // 100)


def overlap(a, b, percent: int):
    """Least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def parity(u: np.ndarray) -> np.ndarray:
    """The sketch of a set: 64-bit words, a power of two of them, bits not fewer
    than shingles."""
    n = max(SKETCH, 1 << (len(u) - 1).bit_length())
    odd = np.bincount((mix(u ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (one a row) at fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def near(x: np.ndarray, y: np.ndarray, a, b, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with these sketches (one a row) may link."""
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return apart <= a + b - 2 * overlap(a, b, percent)


def _count(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters over all shingles, and the histogram of small set sizes."""

    def run(batches):
        begin_task()
        counters, sizes = np.zeros(COUNTERS, dtype=np.int64), np.zeros(PART, dtype=np.int64)
        seen = False
        for whole in batches:
            for b in text_slices(whole):
                seen = True
                sets = list(shingle_sets(b.column("text"), width))
                if sets:
                    counters += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                    sizes += np.bincount(np.minimum([len(s) for s in sets], PART - 1), minlength=PART)
        if seen:
            parts = [p.astype("<i8").tobytes() for p in (*counters.reshape(-1, PART), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
                counts = np.frombuffer(raw, dtype="<i8")
                sums[part] = sums[part] + counts if part in sums else counts
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    n = COUNTERS // PART
    rows = docs.select("text").mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).collect()  # n + 1 rows of fixed size
    counters, sizes = np.zeros((n, PART), dtype=np.int64), np.zeros(PART, dtype=np.int64)
    for r in rows:
        counts = np.frombuffer(r["counts"], dtype="<i8")
        if r["part"] < n:
            counters[r["part"]] = counts
        else:
            sizes = counts
    return counters.reshape(-1), sizes


def boundary(sizes: np.ndarray, mean_list: float, percent: int) -> int:
    """The largest size that enumerates: where its subsets are fewer rows than
    its lists, each met with the mean number of other sets."""
    best, chosen, spent = 0.0, 0, 0.0
    for s in range(1, SMALL):
        subsets = sum(comb(s, k) for k in range(slack(s, percent) + 1))
        lists = (slack(s, percent) + 1) * (1 + mean_list)
        spent += float(sizes[s] + 1) * (subsets - lists)
        if subsets > 2000:
            break
        if spent <= best:
            best, chosen = spent, s
    return chosen


def signatures(u: np.ndarray, rank: np.ndarray, edge: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Meeting keys of a set, and each key's place in the set (-1: subset)."""
    size = len(u)
    keys, places = [], []
    if size <= edge:
        each = mix(u)
        total = each.sum(dtype=np.uint64)
        for k in range(slack(size, percent) + 1):
            left = [total - each[list(c)].sum(dtype=np.uint64) for c in combinations(range(size), k)]
            keys.append(mix(np.array(left, dtype=np.uint64) + mix(np.array([size - k], dtype=np.uint64))))
            places.append(np.full(len(left), -1))
    if 100 * size >= percent * (edge + 1):
        first = slack(size, percent) + 1
        order = np.argsort(rank, kind="stable") if first >= size else np.argpartition(rank, first)[:first]
        order = order[np.argsort(rank[order])][:first]
        keys.append(u[order])
        places.append(np.arange(first))
    return np.concatenate(keys), np.concatenate(places)


def sketch(docs: DataFrame, counters: np.ndarray, edge: int, width: int, percent: int) -> DataFrame:
    """(doc_id, rk, size, set_key, keys, places, bits) of every document."""
    level = np.minimum(63, np.ceil(np.log2(counters + 1) * 1.5)).astype(np.uint64) << np.uint64(58)
    shared = docs.sparkSession.sparkContext.broadcast(level)  # COUNTERS * 8 bytes

    def run(batches):
        begin_task()
        level = shared.value
        for whole in batches:
            for b in text_slices(whole):
                sizes, ids, keys, places, bits, offsets = [], [], [], [], [], [0]
                for u in shingle_sets(b.column("text"), width):
                    sizes.append(len(u))
                    ids.append(int(mix(u).sum(dtype=np.uint64).view(np.int64)) if len(u) else 0)
                    if len(u):
                        rank = level[(u & np.uint64(COUNTERS - 1)).astype(np.int64)] | (mix(u) >> np.uint64(6))
                        k, p = signatures(u, rank, edge, percent)
                        keys.append(k)
                        places.append(p)
                    bits.append(parity(u).tobytes() if len(u) else b"")
                    offsets.append(offsets[-1] + (len(k) if len(u) else 0))
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                where = np.concatenate(places).astype(np.int32) if places else np.zeros(0, np.int32)
                at = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("rk"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                     pa.ListArray.from_arrays(at, pa.array(flat)), pa.ListArray.from_arrays(at, pa.array(where)), pa.array(bits, pa.binary())],
                    ["doc_id", "rk", "size", "set_key", "keys", "places", "bits"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(ROW_KEY).alias("rk"), "text")
    return rows.mapInArrow(run, "doc_id long, rk long, size long, set_key long, keys array<long>, places array<int>, bits binary")


def _may_link(a, b, i, j, percent: int):
    """Size filter, and for lists what still can be shared from places i, j on."""
    fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    rest = 1 + np.minimum(a - i - 1, b - j - 1)
    return fits & ((i < 0) | (j < 0) | (rest >= overlap(a, b, percent)))


MET = "crowded boolean, a long, b long"


def _meet(batches, percent: int):
    """Pairs (a, b) of small groups; (key, set) of the members of crowded ones."""
    begin_task()
    for table, _ in _groups(batches, ["key", "set_key", "size", "place"], ["key"]):
        key, node, size, place = (table.column(c).to_numpy() for c in ("key", "set_key", "size", "place"))
        starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        count = np.repeat(np.diff(starts), np.diff(starts))
        last = np.repeat(starts[1:], np.diff(starts))
        crowd = np.flatnonzero(count > CROWD)
        found = [(np.ones(len(crowd), dtype=bool), key[crowd], node[crowd])]
        rows = np.flatnonzero((count > 1) & (count <= CROWD))
        for d in range(1, CROWD):
            rows = rows[rows + d < last[rows]]
            if not len(rows):
                break
            other = rows + d
            ok = _may_link(size[rows], size[other], place[rows], place[other], percent) & (node[rows] != node[other])
            a, b = node[rows[ok]], node[other[ok]]
            found.append((np.zeros(len(a), dtype=bool), np.minimum(a, b), np.maximum(a, b)))
        columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
        yield pa.RecordBatch.from_arrays(columns, ["crowded", "a", "b"])


def _near_pairs(batches, percent: int):
    """Pairs (a, b) whose sketches allow a link."""
    begin_task()
    for batch in batches:
        a, b = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
        raw = [batch.column(c) for c in ("bits_a", "bits_b")]
        words = [pc.binary_length(r).to_numpy() // 8 for r in raw]
        keep = np.zeros(len(a), dtype=bool)
        for wx, wy in set(zip(*(w.tolist() for w in words))):
            rows = np.flatnonzero((words[0] == wx) & (words[1] == wy))
            x, y = (np.frombuffer(b"".join(r.take(pa.array(rows)).to_pylist()), "<u8").reshape(len(rows), w) for r, w in zip(raw, (wx, wy)))
            keep[rows] = near(fold(x, wy), fold(y, wx), a[rows], b[rows], percent)
        keep = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])


def thin(sizes: np.ndarray, sketches: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Pairs (i, j) of a crowded place's sets that may link by their sketches.
    When they are more than ``DENSE`` a set, instead those sets that may link."""
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    words = np.array([len(sketches[k]) // 8 for k in order])
    widths = np.unique(words).tolist()  # grow with the sizes
    begin = np.searchsorted(words, widths)
    ends = np.append(begin[1:], len(sizes)).tolist()
    whole = [np.frombuffer(b"".join(sketches[k] for k in order[lo:hi]), "<u8").reshape(hi - lo, w) for lo, hi, w in zip(begin.tolist(), ends, widths)]
    last = np.searchsorted(percent * sizes, 100 * sizes, side="right")
    flags, found, total = np.zeros(len(sizes), dtype=bool), [], 0
    for g, (lo, hi, w) in enumerate(zip(begin.tolist(), ends, widths)):
        folded = {k: fold(whole[k], w) for k in range(g, len(widths)) if begin[k] < last[hi - 1]}
        for i in range(lo, hi):
            for k, at in folded.items():
                first, end = max(i + 1, int(begin[k])), min(int(last[i]), ends[k])
                if first >= end:
                    continue
                ok = near(at[first - begin[k] : end - begin[k]], whole[g][i - lo], sizes[first:end], sizes[i], percent)
                j = first + np.flatnonzero(ok)
                flags[j] = True
                flags[i] |= len(j) > 0
                found.append((np.full(len(j), i), j))
                total += len(j)
            if total > DENSE * len(sizes):
                flags[i + 1 :] = True  # not looked at yet
                return order[:0], order[:0], np.sort(order[flags])
    i, j = (np.concatenate(c) for c in zip(*found)) if found else (order[:0], order[:0])
    return order[i], order[j], None


def _thin_crowds(batches, percent: int):
    """Crowded places as ``_meet`` gives them, thinned: pairs, and (key, set) of
    what stays crowded, under a key that equal crowds share."""
    begin_task()
    for table, _ in _groups(batches, ["key", "set_key", "size", "bits"], ["key"]):
        nodes, sizes = table.column("set_key").to_numpy(), table.column("size").to_numpy()
        for lo, hi in _bounds(table, ["key"]):
            own = nodes[lo:hi]
            i, j, dense = thin(sizes[lo:hi], table.column("bits").slice(lo, hi - lo).to_pylist(), percent)
            if dense is not None:
                b = own[dense]
                a = np.full(len(b), mix(b.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
            else:
                a, b = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), dense is not None)), pa.array(a), pa.array(b)], ["crowded", "a", "b"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def crowd_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among the sets of one crowded place:
    counts by inverted lists, one set at a time, until all are joined."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting = owner[order]
    begin = np.searchsorted(code[order], np.arange(len(tokens) + 1))
    root = np.arange(n)
    out, first, groups = [], np.cumsum(sizes) - sizes, n
    for i in range(n):
        if groups == 1:
            break
        own = code[first[i] : first[i] + sizes[i]]
        length = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        both = np.bincount(posting[at], minlength=n)
        hit = np.flatnonzero(100 * both >= percent * (sizes[i] + sizes - both))
        fresh, where = np.unique(root[hit], return_index=True)
        for r, j in zip(fresh.tolist(), hit[where].tolist()):
            if r != root[i]:
                out.append((i, j))
                root[root == r] = root[i]
                groups -= 1
    return out


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, rk, n_shingles, set_key (class) and component_id per document."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "jaccard", free=True)
    counters, sizes = _count(docs, width)
    used = counters[counters > 0]
    edge = boundary(sizes, float(np.median(used)) if len(used) else 0.0, percent)
    sets = work.table(sketch(docs, counters, edge, width, percent), "sets")
    classes = sets.where("size > 0").groupBy("set_key").agg(
        F.min("rk").alias("rk"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("places").alias("places"), F.first("bits").alias("bits")
    )
    classes = work.table(classes, "classes")
    members = work.table(sets.select("doc_id", "rk", "size", "set_key"), "members")
    work.drop("sets")  # the keys are in the classes
    rows = classes.select("set_key", "size", F.explode(F.arrays_zip("keys", "places")).alias("z")).select(
        F.col("z.keys").alias("key"), "set_key", "size", F.col("z.places").alias("place")
    )
    dealt = rows.repartition("key").sortWithinPartitions("key", "set_key")
    met = work.table(dealt.mapInArrow(lambda b: _meet(b, percent), MET), "met")

    def sketch_of(side: str) -> DataFrame:
        return classes.select(F.col("set_key").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}"))

    # what the sketches tell apart goes before any set is moved
    places = met.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("set_key")).join(classes.select("set_key", "size", "bits"), "set_key")
    places = places.select("key", "set_key", "size", "bits").repartition("key").sortWithinPartitions("key", "set_key")
    thinned = work.table(places.mapInArrow(lambda b: _thin_crowds(b, percent), MET), "thinned")
    some = met.where("not crowded").select("a", "b").distinct().join(sketch_of("a"), "a").join(sketch_of("b"), "b")
    some = some.select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(lambda b: _near_pairs(b, percent), "a long, b long")
    pairs = work.table(some.unionByName(thinned.where("not crowded").select("a", "b")).distinct(), "pairs")
    crowds = work.table(thinned.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("set_key")).distinct(), "crowds")
    work.drop("met", "thinned")
    needed = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).unionByName(crowds.select("set_key")).distinct()
    wanted = work.table(needed.join(classes.select("set_key", "rk"), "set_key"), "wanted")
    work.drop("classes")
    bits = spark.sparkContext.broadcast(bit_filter(wanted, "rk"))  # of fixed size

    def load(batches):
        begin_task()
        for whole in batches:
            positions = (whole.column(c).to_numpy() for c in ("p", "q"))
            may = pa.array(hits(bits.value, *positions))
            for b in text_slices(whole.filter(may)):
                raw = [s.tobytes() for s in shingle_sets(b.column("text"), width)]
                yield pa.RecordBatch.from_arrays([b.column("rk"), pa.array(raw, pa.binary())], ["rk", "items"])

    # the filter is applied where the sets are made: one Python worker a task
    p, q = spots("rk")
    source = docs.select(F.expr(ROW_KEY).alias("rk"), "text").select("rk", p.alias("p"), q.alias("q"), "text")
    loaded = source.mapInArrow(load, "rk long, items binary").dropDuplicates(["rk"])
    items = work.table(wanted.join(loaded, "rk").select("set_key", "items"), "items")

    def check(batches):
        begin_task()
        for b in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])

    with_a = pairs.join(items.select(F.col("set_key").alias("a"), F.col("items").alias("x")), "a")
    with_b = with_a.join(items.select(F.col("set_key").alias("b"), F.col("items").alias("y")), "b")
    links = with_b.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")

    def crowd(batches):
        begin_task()
        for table, _ in _groups(batches, ["key", "set_key", "items"], ["key"]):
            a, b = [], []
            nodes = table.column("set_key").to_numpy()
            for lo, hi in _bounds(table, ["key"]):
                own = [np.frombuffer(x, np.uint64) for x in table.column("items").slice(lo, hi - lo).to_pylist()]
                for i, j in crowd_links(own, percent):
                    a.append(nodes[lo + i])
                    b.append(nodes[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    gathered = crowds.select("key", "set_key").join(items, "set_key").repartition("key").sortWithinPartitions("key", "set_key")
    links = work.table(links.unionByName(gathered.mapInArrow(crowd, "a long, b long")), "links")
    work.drop("pairs", "crowds", "wanted", "items")
    groups = components(links, work)
    placed = members.join(groups.withColumnRenamed("node", "set_key"), "set_key", "left")
    placed = placed.select("doc_id", "rk", F.col("size").alias("n_shingles"), "set_key", F.coalesce("component", "set_key").alias("component"))
    least = placed.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    alone = placed.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = placed.where("n_shingles > 0").join(least, "component").withColumn("component_id", F.col("least"))
    columns = ["doc_id", "rk", "n_shingles", "set_key", "component", "component_id"]
    return out.select(*columns).unionByName(alone.select(*columns))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of linked or equal sets: the least
    (doc_id, row key), and of equal rows one.  Rows with empty sets all stay."""
    spark = docs.sparkSession
    work = Workspace(spark, "keep_one")
    found = work.table(join(docs.select("doc_id", "text"), width, percent), "found")
    place = F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "rk")
    stay = found.where("n_shingles > 0").groupBy("component").agg(F.min(place).alias("stay")).select(F.col("stay.rk").alias("rk"))
    (rk,) = own_names(docs, "rk")
    keyed = docs.withColumn(rk, F.expr(ROW_KEY))
    empty = found.where("n_shingles = 0").select("rk").distinct()
    single = keyed.join(stay.select(F.col("rk").alias(rk)), rk, "left_semi").dropDuplicates([rk])
    without = keyed.join(empty.select(F.col("rk").alias(rk)), rk, "left_semi")
    return single.unionByName(without).drop(rk)


def op3_jaccard_join(spark, sf_dir):
    found = join(documents(spark, sf_dir).select("doc_id", "text"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


#: The same components by brute force over distinct sets.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM words),
sets AS (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM grams),
class AS (SELECT min(doc_id) AS rep, any_value(n) AS n, g FROM sets WHERE n > 0 GROUP BY g),
items AS (SELECT rep, n, unnest(g) AS s FROM class),
shared AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM items a JOIN items b ON a.s = b.s AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS other FROM class UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
least_of AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT s.doc_id, s.n AS n_shingles, CASE WHEN s.n = 0 THEN s.doc_id ELSE l.component END AS component_id
FROM sets s LEFT JOIN class c ON s.g = c.g AND s.n > 0 LEFT JOIN least_of l ON l.node = c.rep
"""
