"""The operators against brute force, libraries and hand-made cases."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quillon.llm.common")

from pyspark.sql import functions as F  # noqa: E402

from quillon.llm import jaccard_join, language_id, line_dedup, lm_scoring, packing, piece_codec, quality_rules, sharding, token_store, topk_search  # noqa: E402
from quillon.llm.arrow import SLICE_BYTES, text_slices  # noqa: E402
from quillon.llm.byte_bpe import byte_bpe  # noqa: E402
from quillon.llm.common import FREE_SHUFFLES, Workspace, components, tokenizer_file  # noqa: E402
from tests.oracle import DATA, rows, tables  # noqa: E402

BPE = tokenizer_file("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = [" ", " ", "  ", "\n", "\t", "a", "the", "'s", "!?", "é", "\x1c", "\x85", "<|endoftext|>", "12", "　", "日本", "Ünï", "\x00", "▁"]


def odd_texts(n: int, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    return [None, ""] + ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(n)]


def passage(seed: int, words: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(words))


def make(spark, texts, extra: bool = True):
    """Documents with repeated rows, null ids and columns of clashing names."""
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    data += [data[-1], (None, "a text without an id, " + passage(99), None, None, 5)]
    df = spark.createDataFrame(data, SCHEMA)
    if extra:
        names = ["length", "start", "shard", "key", "rk", "kept", "score", "lang_pred", "n_words", "drop", "component", "_pass", "size"]
        df = df.withColumns({c: F.lit("own") for c in names})
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- token ids


def whole_ids(texts, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = plain
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_cached_encoder_equals_the_library():
    texts = odd_texts(3000) + [passage(1, 3000)]
    ids, bounds = byte_bpe(BPE).encode_array(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole_ids(texts)


def test_special_tokens_as_the_library_has_them():
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x\n<|endoftext|>y", "<|endoftext", None]
    for plain in (False, True):
        ids, bounds = byte_bpe(BPE, encode_special_tokens=plain).encode_array(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole_ids(texts, plain)
    assert whole_ids(texts[:1]) == [[50256]]


def test_merges_of_many_words_equal_the_library():
    encoder, rng = byte_bpe(BPE), random.Random(6)
    words = ["".join(rng.choices("abehinorst", k=rng.randint(1, 60))) for _ in range(3000)] + ["a" * k for k in range(1, 60)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    sizes = np.array([len(w) for w in words])
    spaced = np.arange(len(words)) % 2 == 1
    ids, counts, long = encoder.merges(data, np.cumsum(sizes) - sizes, sizes, spaced)
    ends = np.cumsum(counts)
    for k, word in enumerate(words):
        want = [t.id for t in encoder.model.tokenize(encoder.symbols[32] * int(spaced[k]) + word)]
        assert long[k] == (sizes[k] + spaced[k] > encoder.merges.WIDTHS[-1])
        assert long[k] or ids[ends[k] - counts[k] : ends[k]].tolist() == want


def test_ids_are_as_wide_as_the_vocabulary_needs(tmp_path):
    assert token_store.id_width(BPE, 0) == 2 and token_store.id_width(BPE, 1 << 16) == 4


def test_cache_restarts(monkeypatch):
    from quillon.llm.byte_bpe import ByteBpe

    encoder, texts = ByteBpe(BPE, 50), [passage(i) for i in range(30)]
    for t in texts + texts[-3:]:
        ids, _ = encoder.encode_array(pa.array([t]))
        assert ids.tolist() == whole_ids([t])[0]


def test_store_round_trip(spark):
    shared = passage(5, 2500)
    texts = odd_texts(40) + [shared, shared, passage(6, 800) + " " + shared, shared + " x", passage(7, 9000)]
    docs = make(spark, texts)
    path = Workspace(spark, "test").path("store")
    token_store.write(docs, path, BPE, bucket_ids=3000)
    token_store.verify(spark, path)
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in token_store.read(spark, path).collect())
    data = sorted(((r.doc_id is not None, r.doc_id or 0, whole_ids([r.text])[0] + [0]) for r in docs.collect()), key=lambda r: r[:2])
    start = 0
    for (has, doc, ids), (at, got_doc, raw) in zip(data, got, strict=True):
        assert (got_doc if has else 0) == doc and at == start and np.frombuffer(raw, "<u4").tolist() == ids
        start += len(ids)
    summary = {(r.start, r.ids_crc32) for r in token_store.read(spark, path, digest_only=True).collect()}
    assert summary == {(at, zlib.crc32(raw)) for at, _, raw in got}


def test_store_holds_chunks_once_and_notices_damage(spark):
    shared = passage(5, 4000)
    docs = spark.createDataFrame([(i, shared) for i in range(6)], "doc_id long, text string")
    path = Workspace(spark, "test").path("store")
    token_store.write(docs, path, BPE)
    records = spark.read.parquet(f"{path}/records")
    sizes = records.select(F.octet_length("payload")).toPandas().iloc[:, 0]
    assert (sizes > 0).sum() == 1
    broken = Workspace(spark, "test").path("broken")
    records.withColumn("payload", F.expr("overlay(payload placing x'ffff' from 11)")).write.partitionBy("bucket").parquet(f"{broken}/records")
    with pytest.raises(Exception, match="damaged"):
        token_store.read(spark, broken).collect()
    records.where("doc_id <> 3").write.partitionBy("bucket").parquet(f"{broken}2/records")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{broken}2/manifest")
    with pytest.raises(ValueError, match="manifest"):
        token_store.verify(spark, f"{broken}2")


def test_cut_points_cover_the_document():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 5000, 20_000):
        marks = np.flatnonzero(rng.random(n) < 1 / 400)
        ends = token_store.cut_points(marks, n)
        assert (ends[-1] if n else 0) == (n or 0) and ends == sorted(set(ends))
        assert all(b - a <= token_store.MAX_CHUNK for a, b in zip([0, *ends], ends))


def test_store_of_nothing(spark, empty):
    path = Workspace(spark, "test").path("store")
    assert token_store.write(empty, path, BPE)["documents"] == 0


# ---------------------------------------------------------------- packing


def check_packing(docs, got, limit):
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen: dict = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r)
    for doc, pieces in seen.items():
        ids = np.array(whole_ids([texts[doc]])[0] + [1], "<u4")
        copies = sum(r.doc_id == doc for r in docs.collect())
        cover = sorted((p.start, p.length) for p in pieces)
        assert sum(n for _, n in cover) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]]).tolist()[:-1]
        assert sum(r.length for r in own) <= limit
    return by_sequence


def test_packing(spark, empty):
    docs = make(spark, odd_texts(60) + [passage(i, 5 + 37 * i % 900) for i in range(40)])
    got = packing.pack(docs, BPE, 256).collect()
    by_sequence = check_packing(docs, got, 256)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack(empty, BPE).collect() == []


def test_plan_counts_every_length_and_packs_tightly():
    rng = random.Random(3)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        p = packing.plan(histogram, 64)
        fill = [0] * p.sequences
        for length in histogram:
            lows = [int(x) for x in p.lo[p.length == length]]
            assert lows == sorted(lows) and lows[0] == 0
        for i in range(len(p.length)):
            same = (p.length == p.length[i]) & (p.lo > p.lo[i])
            end = int(p.lo[same].min()) if same.any() else histogram[int(p.length[i])]
            for k in range(end - int(p.lo[i])):
                fill[int(p.base[i]) + k] += int(p.length[i])
        assert all(0 < f <= 64 for f in fill) and sum(fill) == sum(k * n for k, n in histogram.items())
    even = packing.plan({k: 1000 for k in range(1, 65)}, 64)
    assert even.sequences <= 1.02 * sum(1000 * k for k in range(1, 65)) / 64


# ---------------------------------------------------------------- joins


def brute_components(sets, percent):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "".join(rng.choices("xyz", k=5))
    return " ".join(words)


@pytest.mark.parametrize("width, percent, crowd", [(3, 90, 32), (5, 80, 32), (5, 80, 2), (3, 90, 1)])
def test_jaccard_components(spark, monkeypatch, width, percent, crowd):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    rng = random.Random(width * crowd)
    texts = odd_texts(30) + ["one two", "One TWO", "one"]
    for g in range(14):
        base = passage(200 + g, rng.choice([8, 14, 25, 60, 200, 500]))
        texts += [base, base] + [edited(base, rng.random(), rng.randint(0, 3)) for _ in range(9)]
    docs = make(spark, texts)
    got = jaccard_join.join(docs, width, percent).collect()
    data = sorted({(r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect()}, key=lambda r: r[0])
    sets = [shingles(t, width) for _, t in data]
    root = brute_components(sets, percent)
    least: dict = {}
    for (doc, _), r in zip(data, root):
        if doc >= 0:
            least[r] = min(least.get(r, doc), doc)
    want = {doc: (len(s), least.get(r)) for (doc, _), s, r in zip(data, sets, root) if doc >= 0}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == docs.count()
    kept = jaccard_join.keep_one(docs, width, percent)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None and shingles(r.text, width)]
    assert sorted(ids) == sorted({v for n, v in want.values() if n})


@pytest.mark.parametrize("crowd", [32, 4])
def test_jaccard_moves_only_sets_that_may_link(spark, monkeypatch, crowd):
    """Texts that meet in a shared rare passage but differ elsewhere: their sets
    are told apart by sketches and not sent to be verified."""
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    moved, table = {}, Workspace.table

    def counted(self, df, name, *args, **kwargs):
        out = table(self, df, name, *args, **kwargs)
        moved[name] = moved.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Workspace, "table", counted)
    texts = [f"{passage(500)} {passage(1000 + k, 90)}" for k in range(20)]  # alike in a third of their words
    near = passage(7, 200).split()
    texts += [" ".join(near), " ".join([*near[:-1], "zzz"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, 3, 90).collect()}
    assert got == {**{k: k for k in range(20)}, 20: 20, 21: 20}
    assert moved["items"] == 2


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_sketches_lose_no_link(monkeypatch, percent):
    rng = np.random.default_rng(percent)
    bases = [rng.integers(0, 1 << 63, size=n, dtype=np.uint64) for n in (3, 60, 64, 70, 130, 250)]
    sets = []
    for k in range(120):
        base, m = bases[k % len(bases)], int(rng.integers(0, 30))
        m = m * len(base) // 200
        sets.append(np.unique(np.concatenate([base[m:], rng.integers(0, 1 << 63, size=m // 2, dtype=np.uint64)])))
    links = {(i, j) for i in range(120) for j in range(i + 1, 120) if jaccard_join.linked(sets[i], sets[j], percent)}
    sizes, sketches = np.array([len(s) for s in sets]), [jaccard_join.parity(s).tobytes() for s in sets]
    monkeypatch.setattr(jaccard_join, "DENSE", 1)
    i, j, dense = jaccard_join.thin(sizes, sketches, percent)
    assert len(links) > 120 and {k for pair in links for k in pair} <= set(dense.tolist())
    monkeypatch.setattr(jaccard_join, "DENSE", 120)
    i, j, dense = jaccard_join.thin(sizes, sketches, percent)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert dense is None and found >= links


def test_jaccard_matches_sql(spark, empty):
    got = jaccard_join.op3_jaccard_join(spark, DATA).toPandas()
    assert rows(got) == rows(tables().execute(jaccard_join.JACCARD_SQL).df())
    assert jaccard_join.join(empty).collect() == []


@pytest.mark.parametrize("width", [3, 5])
def test_shingle_sets_of_every_slice(width):
    texts = odd_texts(31) + [edited(passage(60 + k, 40 + k), k, 2).title() for k in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    slices = list(text_slices(batch, limit=600))
    assert len(slices) > 3
    got = [len(s) for b in slices for s in jaccard_join.shingle_sets(b.column("text"), width)]
    assert got == [len(shingles(t, width)) for t in texts]


def test_jaccard_over_several_slices_a_batch(spark):
    """Texts beyond the first ``SLICE_BYTES`` of a batch are joined as the first."""
    texts = [passage(900 + k, 20000).title() for k in range(52)]
    assert sum(map(len, texts)) > 1.5 * SLICE_BYTES
    texts += [texts[0].lower(), edited(texts[51], 1, 5)] + [passage(990 + k, 60) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 3, 90).collect()}
    assert got == {k: (len(shingles(t, 3)), {52: 0, 53: 51}.get(k, k)) for k, t in enumerate(texts)}


def test_near_copies_over_several_slices_a_batch(spark):
    """The pipeline's stage keeps one of each group wherever in a batch its texts lie."""
    texts = [passage(1200 + k, 20000).title() for k in range(52)]
    assert sum(map(len, texts)) > 1.5 * SLICE_BYTES
    texts += [texts[0].lower(), edited(texts[51], 1, 5)] + [passage(1290 + k, 60) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).select("doc_id").collect()}
    assert kept == set(range(len(texts))) - {52, 53}


def test_join_leaves_no_keys_behind(spark, monkeypatch):
    """Tables of meeting keys go before the sets are loaded; the session's setting stays."""
    at, there = [], []
    own = Workspace.table

    def table(self, df, name, *rest, **more):
        out = own(self, df, name, *rest, **more)
        at.append(self.at.removeprefix("file://"))
        if name == "items":
            there.extend(os.listdir(at[-1]))
        return out

    monkeypatch.setattr(Workspace, "table", table)
    before = spark.conf.get(FREE_SHUFFLES, None)
    docs = make(spark, [passage(1), passage(1) + " more", passage(2), "", None])
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, 3, 90).collect() if r.doc_id is not None}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert "items" in there and not {"sets", "classes"} & set(there)
    assert spark.conf.get(FREE_SHUFFLES, None) == before


def test_boundary_follows_the_cost():
    sizes = np.ones(jaccard_join.PART, dtype=np.int64) * 100
    short, long = jaccard_join.boundary(sizes, 0.0, 90), jaccard_join.boundary(sizes, 1000.0, 90)
    assert short < long


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    root: dict = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}


# ---------------------------------------------------------------- sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, empty):
    docs = make(spark, odd_texts(200), extra=False)
    got = sharding.place(sharding.measure(docs), n_salts=5).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 40), jump(r.doc_id or 0, 41))
        assert r.grown_shard in (r.shard, 40)
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    assert sharding.place(sharding.measure(empty)).collect() == []


def test_jump_hash_extremes(spark):
    keys = [-5, -(1 << 63), (1 << 63) - 1, 0, 7]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), 1000).alias("s")).collect()
    assert [r.s for r in got] == [jump(r.k, 1000) for r in got]


# ---------------------------------------------------------------- quality


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where: dict = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    cover = {k for at in where.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_base_counts():
    texts = odd_texts(400) + ["a b c d e f g h i a b c d e f g h", "x\nx\n\n \nx", "w " * 40, passage(1) + "\n" + passage(1)]
    got = quality_rules.base_counts(pa.array(texts, pa.string()))
    assert [tuple(int(got[c][i]) for c in quality_rules.COUNTS) for i in range(len(texts))] == [base_counts(t) for t in texts]
    assert all(len(v) == 0 for v in quality_rules.base_counts(pa.array([], pa.string())).values())


def test_model_is_a_distribution():
    text = pa.array([passage(i, 300) for i in range(20)], pa.large_string())
    data, bounds = quality_rules.string_bytes(text)
    code, n = np.unique(quality_rules.codes(data, bounds[:-1]), return_counts=True)
    model = quality_rules.kneser_ney(code, n)
    k = quality_rules.K
    for context in (int(code[5]) // k, int(code[900 % len(code)]) // k, 17 * k * k):
        p = 2.0 ** model.log2(context * k + np.arange(k))
        assert abs(p.sum() - 1) < 1e-3
    assert all((np.diff(h) > 0).all() for h in model.hashes)


def test_codes_start_anew_with_each_text():
    one, other = pa.array(["abc", "", "xy"], pa.large_string()), pa.array(["xy"], pa.large_string())
    (a, ab), (b, bb) = quality_rules.string_bytes(one), quality_rules.string_bytes(other)
    assert quality_rules.codes(a, ab[:-1])[3:].tolist() == quality_rules.codes(b, bb[:-1]).tolist()


def test_bands_reject_gibberish(spark, empty):
    rng = random.Random(4)
    vocabulary = passage(3, 300).split()
    clean = [" ".join(rng.choices(vocabulary, k=150)) for _ in range(60)]
    junk = ["".join(rng.choices("#$qzxv@~^{}[]", k=600)).replace("q", " ") for _ in range(2)]
    docs = make(spark, clean + junk + [None, ""])
    got = {r.doc_id: r for r in quality_rules.judge(docs, ["doc_id"]).collect()}
    assert sum(got[i].kept for i in range(60)) == 60
    assert not any(got[i].kept for i in range(60, 64))
    assert quality_rules.judge(empty, ["doc_id"]).collect() == []
    whole = quality_rules.judge(docs, docs.columns, "_q_")
    assert whole.select(docs.columns).columns == docs.columns and whole.count() == docs.count()


def brute_kneser_ney(grams, k, order):
    """log2 probability of each n-gram's last symbol, from the published formulas."""
    counts = {order: {}}
    for g in grams:
        counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):  # distinct symbols before
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    discount, total, kinds = {}, {}, {}
    for n, own in counts.items():
        c = [sum(v == i for v in own.values()) for i in range(1, 5)]
        if c[0]:
            y = c[0] / (c[0] + 2 * c[1])
            d = [i - (i + 1) * y * c[i] / c[i - 1] if c[i - 1] else i / 2 for i in (1, 2, 3)]
            discount[n] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        else:
            discount[n] = [0.5] * 3
        for g, v in own.items():
            total[n, g[:-1]] = total.get((n, g[:-1]), 0) + v
            kinds.setdefault((n, g[:-1]), [0, 0, 0])[min(v, 3) - 1] += 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / k
        if (n, g[:-1]) not in total:
            return p(g[1:])
        gamma = sum(a * b for a, b in zip(discount[n], kinds[n, g[:-1]])) / total[n, g[:-1]]
        v = counts[n].get(g, 0)
        own = (v - discount[n][min(v, 3) - 1]) / total[n, g[:-1]] if v else 0.0
        return own + gamma * p(g[1:])

    return {g: float(np.log2(p(g))) for g in counts[order]}


def brute_kept(rows):
    """doc_id: kept, over (doc_id, lang, text), and which lie too near an edge to tell."""
    order, classes, by_lang, failed = quality_rules.ORDER, quality_rules.CLASSES, {}, {}
    for doc, lang, text in rows:
        raw = [0] * (order - 1) + [int(classes[b]) for b in (text or "").lower().encode()]
        by_lang.setdefault(lang or "und", {})[doc] = [tuple(raw[i : i + order]) for i in range(len(raw) - order + 1)]
        c = base_counts(text or "")
        failed[doc] = c[0] < 20 or 100 * c[-1] > 30 * c[0]
    kept, near = {}, set()
    for docs in by_lang.values():
        log_p = brute_kneser_ney([g for own in docs.values() for g in own], quality_rules.K, order)
        score = {doc: -sum(log_p[g] for g in own) / max(len(own), 1) for doc, own in docs.items()}
        passed = sorted(v for doc, v in score.items() if not failed[doc])
        q = [passed[max(-(-len(passed) * k // 4) - 1, 0)] for k in (1, 2, 3)] if passed else [0.0] * 3
        for doc, v in score.items():
            slack = quality_rules.SYMBOL_DEVIATION / max(len(docs[doc]), 1) ** 0.5
            width = (((q[2] - q[0]) / 1.349) ** 2 + slack**2) ** 0.5
            edges = -quality_rules.LOWER * width, quality_rules.UPPER * width
            kept[doc] = not failed[doc] and edges[0] <= v - q[1] <= edges[1]
            if not failed[doc] and min(abs(v - q[1] - e) for e in edges) < 1e-4:
                near.add(doc)
    return kept, near


def test_kept_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want, near = brute_kept([(r.doc_id, r.lang, r.text) for r in docs.collect()])
    got = {r.doc_id: r.kept for r in quality_rules.op5_ngram_quality(spark, DATA).collect()}
    assert got.keys() == want.keys() and len(near) < 3
    assert {d for d in got if got[d] != want[d]} <= near
    assert 0 < sum(not v for v in got.values()) < len(got) / 2


def test_bands_reject_four_spreads_on_either_side(spark):
    rows = [(x, 5.0, 0.1, 10_000) for x in (4.6, 4.8, 5.0, 5.2, 5.4)]
    df = spark.createDataFrame(rows, "p double, _middle double, _spread double, _n_bytes long")
    assert [r.k for r in df.select("p", quality_rules.within_band(*map(F.col, ("p", "_n_bytes", "_middle", "_spread"))).alias("k")).orderBy("p").collect()] == [False, True, True, True, False]


# ---------------------------------------------------------------- pieces


def test_pieces_equal_the_library(spark, empty):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=model), piece_codec.piece_codec(model)
    texts = odd_texts(2500, 5) + ["x" * 5000, " ".join(["word"] * 400), "日本語" * 300, " lead", "trail ", "a  b", "\n\n", "a\n b"]
    assert [codec.encode(t) for t in texts] == [library.encode(t or "") for t in texts]
    rng = random.Random(6)
    for _ in range(2000):
        ids = rng.choices([rng.randrange(32000), rng.randrange(3, 259), 28705, 259, 0, 1, 2], k=rng.randint(0, 8))
        assert codec.decode(ids) == library.decode(ids)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got = {r.doc_id: tuple(r)[1:] for r in piece_codec.digest_column(make(spark, texts[:300]), model).collect() if r.doc_id is not None}
    for i, t in enumerate(texts[:300]):
        ids = library.encode(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert piece_codec.digest_column(empty, model).collect() == []


# ---------------------------------------------------------------- lines


def brute_lines(docs):
    """Lines that stay, by document: exact and near lines lose all but the first."""
    found = []
    for doc, text in docs:
        norm = line_dedup.normalised(pa.array((text or "").split("\n"), pa.large_string())).to_pylist()
        found += [(doc, i, n) for i, n in enumerate(norm) if len(n.split(" ")) >= line_dedup.MIN_WORDS]
    distinct = list(dict.fromkeys(n for _, _, n in found))
    sims = line_dedup.line_sketches(pa.array(distinct, pa.large_string()))[3] if distinct else []
    root = {n: n for n in distinct}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(distinct):
        for j in range(i):
            if int(sims[i] ^ sims[j]).bit_count() <= line_dedup.MAX_BITS and line_dedup.edit_similar(a, distinct[j]):
                root[find(a)] = find(distinct[j])
    first: dict = {}
    for doc, i, n in found:
        first.setdefault(find(n), (doc, i))
    return {(doc, i) for doc, i, n in found if first[find(n)] != (doc, i)}


def test_line_dedup(spark, empty):
    rng = random.Random(8)
    lines = [passage(300 + i, rng.choice([4, 9, 30, 90, 300])) for i in range(30)]
    near = [edited(x, i, 1) for i, x in enumerate(lines)]
    texts = ["\n".join(rng.choices(lines + near + ["short", ""], k=rng.randint(0, 9))) for _ in range(60)]
    texts += [None, "", lines[5].upper() + "!!", lines[7], lines[7]]
    docs = make(spark, texts)
    clean = line_dedup.dedup_lines(docs)
    assert sorted(set(clean.columns) - {"n_dropped"}) == sorted(docs.columns)
    gone = brute_lines(list(enumerate(texts)) + [(len(texts), "a text without an id, " + passage(99))])
    got = {r.doc_id: (r.text, r.n_dropped) for r in clean.collect() if r.doc_id is not None}
    for doc, text in enumerate(texts):
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in gone)
        assert got[doc] == (left, sum(d == doc for d, _ in gone))
    assert clean.count() == docs.count()
    assert line_dedup.dedup_lines(empty).collect() == []


def test_short_lines_and_scripts_without_blanks_take_part(spark):
    chinese, changed = "本网站所有内容未经书面许可不得以任何方式转载", "本网站所有内容未经书面许可不得以任何形式转载"
    texts = ["Subscribe to our newsletter\nfirst", "subscribe to our newsletter!\nfirst", "All rights reserved", "all rights reserved.", chinese, chinese, changed]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == ("first", 1)  # under both floors: stays
    assert [got[i][1] for i in (0, 2, 3, 4, 5, 6)] == [0, 0, 1, 0, 1, 1]


def test_line_recall_against_edit_similarity_alone(spark):
    """Pairs of lines that differ in one word, by brute force on edit similarity."""
    found = similar = 0
    pairs = [(x, edited(x, i, 1)) for i, x in enumerate(passage(900 + i, (8, 10, 20, 30, 50)[i % 5]) for i in range(200))]
    docs = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()}
    for i, (a, b) in enumerate(pairs):
        if line_dedup.edit_similar(a, b):
            similar, found = similar + 1, found + got[2 * i + 1]
    assert similar > 190 and found >= 0.9 * similar
    assert sum(got.values()) == found


def similar_pairs(lines):
    """All pairs of lines at edit similarity 0.8, found without the operator's
    hashes: an edit changes at most three trigrams, so most pairs fall by counts."""
    grams = np.zeros((len(lines), 512), dtype=np.int16)
    for i, x in enumerate(lines):
        for k in range(len(x) - 2):
            grams[i, zlib.crc32(x[k : k + 3].encode()) % 512] += 1
    sizes = np.array([len(x) for x in lines])
    for i, x in enumerate(lines):
        rest = grams[i + 1 :]
        more = np.maximum(grams[i] - rest, 0).sum(axis=1), np.maximum(rest - grams[i], 0).sum(axis=1)
        allowed = 0.2 * np.maximum(sizes[i], sizes[i + 1 :]) + 1e-6
        for j in np.flatnonzero((np.abs(sizes[i + 1 :] - sizes[i]) <= allowed) & (np.maximum(*more) <= 3 * allowed)):
            if line_dedup.edit_similar(x, lines[i + 1 + j]):
                yield i, i + 1 + int(j)


def test_line_recall_on_real_lines(spark):
    """Lines dropped against those that brute force over all pairs drops."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    owner, number, flat = line_dedup.lines_of(pa.array([t for _, t in texts], pa.large_string()))
    lines = flat.to_pylist()
    distinct = list(dict.fromkeys(lines))
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = list(similar_pairs(distinct))
    features, starts = line_dedup.grams(pa.array(distinct, pa.large_string()))
    places, sims = line_dedup.meeting_places(features, starts), line_dedup.simhash(features, starts)
    met = [bool((places[i] == places[j]).any()) and int(sims[i] ^ sims[j]).bit_count() <= line_dedup.MAX_BITS for i, j in pairs]
    print(f"line pairs at edit similarity 0.8: {len(pairs)}, met: {sum(met) / len(pairs):.3f}")
    assert sum(met) >= 0.9 * len(pairs)
    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    seen, want = set(), 0
    for x in lines:
        group = find(distinct.index(x))
        want += group in seen
        seen.add(group)
    got = sum(r.n_dropped for r in line_dedup.dedup_lines(docs).collect())
    assert 0.9 * want <= got <= want


def test_lines_are_compared_once(spark):
    """Lines that meet in many tables are compared in the first only."""
    base = passage(77, 40)
    near = [edited(base, i, 1) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate([base, *near])), "doc_id long, text string")
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(docs).collect()) == [0] + [1] * 12


def test_line_dedup_carries_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five\nsix"), (2, "one two three four five\nseven")], "doc_id long, text string")
    names = ["_rk", "_pass", "_lost", "_d_rk", "_d_lines", "key", "block"]
    got = line_dedup.dedup_lines(docs.withColumns({n: F.lit("own") for n in names})).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["one two three four five\nsix", "seven"]
    assert all(r[n] == "own" for r in got for n in names)


def test_edit_similarity():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choices("abc", k=rng.randint(0, 14)))
        b = "".join(c for c in a if rng.random() > 0.1) + "".join(rng.choices("abc", k=rng.randint(0, 2)))
        longer = max(len(a), len(b))
        assert line_dedup.edit_similar(a, b) == (5 * distance(a, b) <= longer)
    for letters in ("ab ", "abcdefgh ijkl", "aé日\U0001f600 "):
        pairs = []
        for _ in range(150):
            a = "".join(rng.choices(letters, k=rng.randint(1, 60)))
            pairs.append((a, "".join(c if rng.random() > 0.15 else rng.choice(letters) * rng.randint(0, 2) for c in a)))
        pairs += [(b, a) for a, b in pairs[:40]] + [("x" * 3500, "x" * 1500 + "y" * 500 + "x" * 1500)]
        want = [5 * distance(a, b) <= max(len(a), len(b)) for a, b in pairs[:-1]] + [True]
        assert line_dedup.all_similar(pairs).tolist() == want


def test_distances_of_many_long_pairs():
    """As one by one, at the ends of machine words too, in a quarter of the time."""
    rng = random.Random(8)
    pairs = []
    for size in [63, 64, 65, 127, 128, 129] * 20 + [400] * 1200:
        a = "".join(rng.choices("abcdefgh ij\u00e9", k=size))
        rate = rng.uniform(0.05, 0.3)
        pairs.append((a, "".join(c if rng.random() > rate else rng.choice("abcd ") * rng.randint(0, 2) for c in a) + rng.choice("ab")))
    began = time.process_time()
    want = [line_dedup.edit_similar(a, b) for a, b in pairs]
    alone = time.process_time() - began
    assert 100 < sum(want) < len(pairs) - 100
    began = time.process_time()
    assert line_dedup.all_similar(pairs).tolist() == want
    assert time.process_time() - began < alone / 4


def test_sketches_by_portions(monkeypatch):
    """Places and SimHashes do not depend on the portions they are worked out in."""
    lines = pa.array([passage(k, 1 + k % 40) for k in range(60)], pa.large_string())
    features, starts = line_dedup.grams(lines)
    whole = line_dedup.meeting_places(features, starts), line_dedup.simhash(features, starts)
    monkeypatch.setattr(line_dedup, "PORTION", 100)
    assert (line_dedup.meeting_places(features, starts) == whole[0]).all() and (line_dedup.simhash(features, starts) == whole[1]).all()


def test_simhash_counts_long_lines():
    features = line_dedup.mix(np.arange(2000, dtype=np.uint64))
    starts = np.array([0, 3, 3 + 700, 2000])
    want = []
    for lo, hi in zip(starts, starts[1:]):
        bits = (features[lo:hi, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        want.append(sum(1 << k for k in range(64) if 2 * int(bits[:, k].sum()) > hi - lo))
    assert line_dedup.simhash(features, starts).tolist() == want


# ---------------------------------------------------------------- models


def test_language_id(spark, empty):
    rng = random.Random(5)
    tongues = {"aa": "the of and ing tion".split(), "bb": "der und sch keit ung".split(), "cc": "ción que los ado ñ".split()}

    def say(tongue, n):
        return " ".join("".join(rng.choices(tongues[tongue], k=rng.randint(1, 3))) for _ in range(n))

    data = [(i, say(t, rng.randint(8, 90)), t, "s", 0) for i, t in enumerate(rng.choices(list(tongues), k=240))]
    docs = spark.createDataFrame(data, SCHEMA)
    net = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.predict(docs.withColumn("score", F.lit("own")).withColumn("held", language_id.held_out(F.col("doc_id"))), net).collect()
    held = [r for r in out if r.held]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    odd = language_id.predict(make(spark, [None, "", "12 34 !?", "the of", "x" * 100_000]), net).collect()
    by_id = {r.doc_id: r.lang_pred for r in odd}
    assert [by_id[i] for i in range(3)] == ["und"] * 3 and by_id[3] in tongues and by_id[4] in tongues
    assert language_id.train(empty) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(empty, net).collect() == []


def test_held_out_is_by_crc(spark):
    got = spark.range(200).select("id", language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_windows_cover_whole_texts():
    texts = pa.array(["", "ab", "x" * 256, "y" * 700], pa.large_string())
    windows, owner, filled = language_id.windows_of(texts)
    assert owner.tolist() == [1, 2, 3, 3, 3] and filled.tolist() == [2, 256, 256, 256, 188]
    assert windows[0, :3].tolist() == [97, 98, 0] and (windows[4, :188] == 121).all()


def test_lm_scores_prefer_what_it_learnt(spark, empty):
    rng = random.Random(6)
    chain = [f"w{i}" for i in range(40)]
    ordered = [" ".join(chain[(s + k) % 40] for k in range(120)) for s in range(80)]
    mixed = [" ".join(rng.choices(chain, k=120)) for _ in range(4)]
    docs = make(spark, ordered + mixed + [None, "", "..."])
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.train(docs)).collect()}
    good = np.mean([got[i].mean_log_likelihood for i in range(80)])
    bad = np.mean([got[i].mean_log_likelihood for i in range(80, 84)])
    assert good > bad + 0.5
    assert [(got[i].n_tokens, got[i].log_likelihood) for i in (84, 85, 86)] == [(0, 0.0)] * 3
    assert len(got) == 88 and lm_scoring.score(empty, lm_scoring.train(empty)).collect() == []


def test_lm_tells_words_of_one_token_apart(spark):
    """Beyond the TOP words, a counted word scores above one seen once, whatever token they share."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(lm_scoring.TOP)]
    h = {w: lm_scoring.string_hashes(pa.array([w], pa.large_string())) for w in (f"r{i}" for i in range(3000))}
    tokens = {w: int(lm_scoring.hashed(x)[0]) for w, x in h.items()}
    often, once = next((a, b) for a in tokens for b in tokens if a != b and tokens[a] == tokens[b])
    texts = [" ".join(common * 4)] * 3 + [" ".join([*rng.choices(common, k=30), often]) for _ in range(9)] + [f"c1 c2 {w} c3 c4" for w in (often, once)]
    docs = make(spark, texts, extra=False)
    got = {r.doc_id: r.log_likelihood for r in lm_scoring.score(docs, lm_scoring.train(docs)).collect()}
    assert abs(got[12] - got[13] - np.log(10 / 2)) < 1e-3  # the last row occurs twice


@pytest.mark.parametrize("known", [1 << 18, 0])
def test_lm_scores_equal_brute_force(spark, monkeypatch, known):
    """Each word's softmax written out, over real texts; ``known`` 0 joins all counts."""
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, " \n"), (None, "a word, again: a word")], "doc_id long, text string"))
    model = lm_scoring.train(docs)
    words = {r.doc_id: [w.strip(".,;:!?\"'()") for w in (r.text or "").lower().split()] for r in docs.collect()}
    words = {k: [w for w in v if w] for k, v in words.items()}
    counts: dict = {}
    for v in words.values():
        for w in v:
            counts[w] = counts.get(w, 0) + 1
    h = {w: lm_scoring.string_hashes(pa.array([w], pa.large_string())) for w in counts}
    ranked = sorted(counts, key=lambda w: (-counts[w], int(h[w].view(np.int64)[0])))
    token = {w: i + 1 if i < lm_scoring.TOP else int(lm_scoring.hashed(h[w])[0]) for i, w in enumerate(ranked)}
    whole = np.bincount([token[w] for w in ranked[lm_scoring.TOP :]], [counts[w] for w in ranked[lm_scoring.TOP :]], lm_scoring.VOCABULARY)
    p, side = {k: v.astype(np.float64) for k, v in model.net.p.items()}, lm_scoring.SIDE

    def log_softmax(z):
        return z - np.log(np.exp(z - z.max()).sum()) - z.max()

    def brute(own):
        ids, total = [0] * side + [token[w] for w in own] + [0] * side, 0.0
        for k, w in enumerate(own):
            near = ids[k : k + side] + ids[k + side + 1 : k + 2 * side + 1]
            hidden = np.append(np.tanh(p["bias"] + sum(p["inputs"][t] * g for t, g in zip(near, p["gates"]))), 1.0)
            group, member = divmod(token[w], lm_scoring.MEMBERS)
            total += log_softmax(hidden @ p["classes"])[group] + log_softmax(hidden @ p["members"][group])[member]
            if token[w] > lm_scoring.TOP:
                total += np.log(counts[w] / (1 + whole[token[w]]))
        return len(own), total

    got = lm_scoring.score(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        n, total = brute(words[r.doc_id])
        assert r.n_tokens == n and abs(r.log_likelihood - total) < 1e-4 * (1 + n)


def test_lm_does_not_depend_on_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_DOCS", 20)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    few, many = (lm_scoring.train(docs.repartition(n)).net.flat() for n in (1, 7))
    assert np.abs(few - many).max() < 1e-6


def test_lm_portions_depend_on_the_shard_alone(monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEP_BYTES", 10)
    rows = pa.record_batch({"shard": pa.array([0] * 5 + [3] * 4), "text": pa.array(["abcd"] * 3 + [None, "x" * 40] + ["yy"] * 4)})
    whole = [b.to_pydict() for b in lm_scoring.shard_steps([rows])]
    assert [b.to_pydict() for b in lm_scoring.shard_steps(rows.slice(i, 1) for i in range(9))] == whole
    assert sum(len(b["text"]) for b in whole) == 9 and all(len(set(b["shard"])) == 1 for b in whole)
    assert list(lm_scoring.shard_steps([])) == []


def test_lm_trains_on_every_position():
    vocab = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    tokens, (lo, hi), _ = lm_scoring.tokens_of(pa.array(["a b c d e f g", None, "h", "i j"]), vocab)
    masked = np.concatenate(lm_scoring.targets(lo, hi, np.array([3, 0, 2, 1])))
    assert sorted(masked.tolist()) == np.flatnonzero(tokens).tolist() and len(masked) == 10


def test_lm_gradient():
    """A step moves along the gradient: the mean log-probability rises."""
    net, rng = lm_scoring.Network.fresh(), np.random.default_rng(0)
    around, target = rng.integers(0, 50, (256, 4)), rng.integers(0, 50, 256)
    before = net.log_probability(around, target).mean()
    squares = {k: np.zeros_like(v) for k, v in net.p.items()}
    for _ in range(5):
        net.step(around, target, squares)
    assert net.log_probability(around, target).mean() > before + 0.5


def test_lm_probabilities_sum_to_one():
    net = lm_scoring.Network.fresh()
    around = np.tile([1, 2, 3, 4], (lm_scoring.VOCABULARY, 1))
    p = np.exp(net.log_probability(around, np.arange(lm_scoring.VOCABULARY)).astype(np.float64))
    assert abs(p.sum() - 1) < 1e-3


# ---------------------------------------------------------------- search


def brute_top(vectors, k):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(i, []).append(np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64))
    out = set()
    for q in whole:
        if q % 50 == 0:
            scored = sorted((-int(whole[q][0] @ v), i) for i, vs in whole.items() if i != q for v in vs)
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "large"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk_search, "BLOCK", 90)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    x = {"random": rng.standard_normal((400, 8)), "ties": rng.integers(-1, 2, (400, 8)) / 256, "large": rng.standard_normal((400, 8)) * 3e5}[kind].astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(400, None), (450, [None] * 8), (500, [float("nan")] * 8), (551, [float("inf")] * 8), (None, [1.0] * 8), data[0], data[7]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit("own"))
    got = topk_search.top_k(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).collect()
    want = brute_top(data, 5)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_search_with_large_scores_keeps_k_beside_the_own_row():
    rng = np.random.default_rng(2)
    # one block, more than FEW rows, scores beyond 2**52 and bounds loose to the end
    x, ids = (rng.standard_normal((300, 64)) * 2e7).astype(np.int64), np.arange(300)
    own = np.array([299, 150, 0])
    query, column, score, _ = topk_search.search_block(own, x[own], ids, x, 5)
    for i, q in enumerate(own):
        want = sorted((-int(x[q] @ x[c]), c) for c in range(300) if c != q)[:5]
        assert [(-int(s), int(c)) for c, s in zip(column[query == i], score[query == i])] == want


def test_reading_stops_where_outsiders_cannot_qualify():
    rng = np.random.default_rng(5)
    x, ids = np.floor(rng.standard_normal((4000, 64)) * 32).astype(np.int64), np.arange(4000)
    own = np.arange(40)
    scores = x[own] @ x.T
    scores[own, own] = -(1 << 60)
    floors = np.sort(scores[:, 2000:], axis=1)[:, -5]  # reached in another block
    query, column, score, read = topk_search.search_block(own, x[own], ids[:2000], x[:2000], 5, floors)
    assert (read < 1).mean() > 0.9
    for i in own:
        want = sorted((-int(s), int(c)) for c, s in enumerate(scores[i, :2000]) if s >= floors[i])[:5]
        got = [(-int(s), int(c)) for c, s in zip(column[query == i], score[query == i])]
        assert [g for g in got if -g[0] >= floors[i]] == want


@pytest.mark.parametrize("factor", [1, 1 << 8, 1 << 20])
def test_floors_spare_lower_bounds(monkeypatch, factor):
    """With floors only upper bounds are worked out, from any depth on and over
    lists sorted once, and no candidate that reaches the floor is lost."""
    rng = np.random.default_rng(6)
    x, ids = np.floor(rng.standard_normal((700, 8)) * 32).astype(np.int64) * factor, np.arange(700) // 2  # ids repeat
    own = np.arange(0, 40, 2)
    scores = x[own] @ x.T
    floors = np.sort(scores, axis=1)[:, -12]
    monkeypatch.setattr(topk_search, "lower", None)
    lists = topk_search.sorted_lists(x)
    for start in range(len(topk_search.DEPTHS)):
        query, column, score, _ = topk_search.search_block(ids[own], x[own], ids, x, 5, floors, lists, start)
        for i in range(len(own)):
            want = sorted((-int(s), int(ids[c])) for c, s in enumerate(scores[i]) if s >= floors[i] and ids[c] != ids[own[i]])[:5]
            assert [(-int(s), int(ids[c])) for c, s in zip(column[query == i], score[query == i])] == want


def test_vectors_too_long_for_long_scores_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e8, 1.0]), (1, [2.0, 3.0])], "vec_id long, embedding array<double>")
    assert topk_search.top_k(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).collect() == []
    with pytest.raises(Exception, match="too long"):
        topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()


def test_top_k_sql_and_few(spark):
    got = topk_search.op10_topk_search(spark, DATA).toPandas()
    assert rows(got) == rows(tables().execute(topk_search.TOPK_SQL).df())
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(none, F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_enclose_the_scores():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-9, 9, (50, 6)), rng.integers(-9, 9, (7, 6))
    order = np.argsort(-x, axis=0, kind="stable")
    ordered, rank = np.take_along_axis(x, order, axis=0), np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(50)[:, None], axis=0)
    for depth in (1, 10, 49, 50):
        high, low = topk_search.bounds(q, x, rank, ordered, depth)
        assert (low <= q @ x.T).all() and (high >= q @ x.T).all()
    assert (high == low).all()


# ---------------------------------------------------------------- pipeline


def test_language_stage_rejects_unsure_texts(spark, monkeypatch):
    import corpus_pipeline

    scores = [(0, "aa", 0.3), (1, "aa", 0.49), (2, "bb", 0.51), (3, "und", 0.0), (4, "aa", 1.0)]
    docs = spark.createDataFrame([(i, "x", None, "s", 1) for i, _, _ in scores], SCHEMA)
    told = spark.createDataFrame(scores, "doc_id long, _lang_pred string, _score double")
    monkeypatch.setattr(language_id, "train", lambda df: type("Net", (), {"labels": ["aa", "bb", "cc", "dd"]})())
    monkeypatch.setattr(language_id, "predict", lambda df, net, names: df.join(told, "doc_id"))
    kept = corpus_pipeline.identify_language(spark, docs, DATA).collect()
    assert {r.doc_id: r.lang for r in kept} == {2: "bb", 4: "aa"}


def brute_languages(net, rows):
    """doc_id: (label, score) by windows cut one by one."""
    out = {}
    for doc, text in rows:
        raw = (text or "").lower().encode()
        log_p, size = np.zeros(len(net.labels)), 0
        mass = np.zeros(len(net.labels))
        for at in range(0, len(raw), language_id.LENGTH):
            part = raw[at : at + language_id.LENGTH]
            one = np.zeros((1, language_id.LENGTH), np.uint8)
            one[0, : len(part)] = list(part)
            p = net.log_probabilities(one)[0].astype(np.float64)
            log_p, mass, size = log_p + p * len(part), mass + np.exp(p) * len(part), size + len(part)
        lettered = any(c.isalpha() for c in text or "")
        best = int(log_p.argmax())
        out[doc] = (net.labels[best], mass[best] / size) if lettered else ("und", 0.0)
    return out


def test_pipeline(spark, tmp_path):
    """Every stage's decisions against brute force on that stage's own input."""
    import corpus_pipeline

    docs, stages = spark.read.parquet(f"{DATA}/documents.parquet"), dict(corpus_pipeline.STAGES[:-1])
    inputs = {}
    for name, stage in stages.items():
        inputs[name] = docs.collect()
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns, name
        path = os.path.join(tmp_path, name)
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
    inputs["packing"] = docs.collect()
    after = dict(zip(inputs, [{r.doc_id: r for r in v} for v in list(inputs.values())[1:]]))

    rows = inputs["language_id"]
    learnt = spark.createDataFrame(rows, SCHEMA).where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    net = language_id.train(learnt)
    told = brute_languages(net, [(r.doc_id, r.text) for r in rows])
    least = corpus_pipeline.least_score(len(net.labels))
    assert set(after["language_id"]) == {d for d, (lang, score) in told.items() if lang != "und" and score >= least}

    want, near = brute_kept([(r.doc_id, r.lang, r.text) for r in inputs["quality_rules"]])
    assert {d for d in want if want[d]} ^ set(after["quality_rules"]) <= near

    assert set(after["line_dedup"]) == {r.doc_id for r in inputs["line_dedup"]}
    for r in inputs["line_dedup"]:
        left = iter((r.text or "").split("\n"))
        now = after["line_dedup"][r.doc_id]
        assert now.n_chars == len(now.text) and (now.text == "" or all(line in left for line in now.text.split("\n")))

    rows = sorted(inputs["jaccard_join"], key=lambda r: r.doc_id)
    groups = brute_components([shingles(r.text, 5) for r in rows], 80)
    first, stay = set(), set()
    for r, group in zip(rows, groups):
        if not shingles(r.text, 5) or group not in first:
            stay.add(r.doc_id)
        first.add(group)
    assert set(after["jaccard_join"]) == stay

    got = corpus_pipeline.run(spark, DATA).collect()
    check_packing(docs, got, packing.MAX_TOKENS)
    assert {r.doc_id for r in got} == stay


def test_pipeline_stages_define_odd_rows(spark, empty):
    """Nulls, empty and very long texts, repeated rows and clashing names, stage by stage."""
    import corpus_pipeline

    rng = random.Random(12)
    words = [passage(i, 1) for i in range(400)]
    texts = [". ".join(" ".join(rng.choices(words, k=12)) for _ in range(8)) for _ in range(40)]
    texts += [None, "", "12 34", "\n".join(" ".join(rng.choices(words, k=15)) for _ in range(3000))]
    names = ["_rk", "_pass", "_lost", "_lang", "_n_bytes", "_middle", "_q_kept", "_lang_pred", "_score", "_n_dropped", "kept", "component", "key", "rk"]
    docs = make(spark, texts, extra=False).withColumns({c: F.lit("own") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, empty.withColumns({c: F.lit("own") for c in names}), DATA)
        assert nothing.collect() == [], name
        kept = stage(spark, docs, DATA)
        if name == "packing":
            assert "sequence_id" in kept.columns and kept.count() > 40
            continue
        assert kept.columns == docs.columns, name
        got = kept.collect()
        assert all(r[c] == "own" for r in got for c in names), name
        ids = [r.doc_id for r in got]
        if name in ("language_id", "quality_rules"):
            assert not {40, 41, 42} & set(ids), name  # without a word or letter
        else:
            assert {40, 41, 42} <= set(ids) and None in ids, name
        assert 43 in ids and ids.count(43) == (1 if name == "jaccard_join" else 2), name  # the last row comes twice
