"""Language-model scoring by masked pseudo-likelihood.

Spark counts all words; the ``TOP`` most frequent are tokens of their own and
the others share hashed tokens.  A small network sees the ``SIDE`` tokens on
either side of a position, each through its own gate, and predicts the masked
token between them: first its class, then the token within the class.  A
document's score is the sum of the log-probabilities of all its words, each
predicted from both sides.  A word with a hashed token adds its share among the
words of that token.  The shares come from the counts of all words, a table that
grows with the corpus: the counts of the ``KNOWN`` most frequent are sent to the
tasks, those of all others are joined to the tokens.

Training is data-parallel and covers every document and position: a hash deals
the corpus to ``ROUNDS`` parts and within them to shards of about ``SHARD_DOCS``
documents, whatever the number of tasks.  In each round every shard is trained
on in numpy, in the order of a hash and from the same network (in ``STRIDE``
passes over each ``STEP_BYTES`` of texts, each masking every ``STRIDE``-th
position, the first from an offset of the document's own); the networks are then
averaged, weighted by their positions.  Tasks add up their shards first.

Nulls: a null text or one without words has no tokens and scores 0.  Repeated
rows are each scored; words that tie in count are ranked by their hash.  Texts
of any length are taken whole.  Only doc_id and text are read; other columns
take no part.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import begin_task, text_slices
from quillon.llm.common import Workspace, documents
from quillon.llm.line_dedup import mix, string_hashes

SIDE = 2
CLASSES, MEMBERS = 32, 32
VOCABULARY = CLASSES * MEMBERS
TOP = 768  # ids from 1; 0 stands outside texts, the rest is for hashed words
WIDTH = 16
ROUNDS, STRIDE = 2, 4
BATCH, RATE = 4096, 0.1
#: Documents of a training shard; bytes of text that are trained on at once.
SHARD_DOCS, STEP_BYTES = 4096, 1 << 20
#: Words whose counts are sent to every task (16 bytes each).
KNOWN = 1 << 18
NAMES = ["inputs", "gates", "bias", "classes", "members"]
SHAPES = {
    "inputs": (VOCABULARY, WIDTH), "gates": (2 * SIDE, WIDTH), "bias": (WIDTH,),
    "classes": (WIDTH + 1, CLASSES), "members": (CLASSES, WIDTH + 1, MEMBERS),
}


def words_of(texts: pa.Array):
    """Hashes of the distinct words, the words of all texts by index, counts per text."""
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(coded.dictionary, characters=".,;:!?\"'()")
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    index = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if not real.all():
        take = real[index]
        index, owner = index[take], owner[take]
    return string_hashes(words), index, np.bincount(owner, minlength=len(texts))


def count_words(docs: DataFrame) -> DataFrame:
    """(word hash, n) over all texts, each task adding up its slices first."""

    def run(batches):
        begin_task()
        for whole in batches:
            for b in text_slices(whole, limit=16 << 20):
                h, index, _ = words_of(b.column("text"))
                n = np.bincount(index, minlength=len(h))
                seen = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(h[seen].view(np.int64)), pa.array(n[seen].astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hashed(h: np.ndarray) -> np.ndarray:
    """The token that a word outside the TOP shares with others."""
    return (TOP + 1 + mix(h) % np.uint64(VOCABULARY - TOP - 1)).astype(np.int64)


def known_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent words: all above the least
    count that leaves at most ``KNOWN`` of them, and in any case the TOP."""
    capped = F.least("n", F.lit(1 << 16)).alias("n")
    sizes = sorted(map(tuple, counts.groupBy(capped).count().collect()), reverse=True)  # at most 1 << 16 rows
    least, held = 1 << 62, 0
    for n, words in sizes:
        if held + words > KNOWN:
            break
        least, held = n, held + words
    some = counts.where(F.col("n") >= least) if held >= TOP else counts.orderBy(F.desc("n"), "word").limit(TOP)
    some = some.select("word", "n").toArrow()  # at most KNOWN rows
    hashes, n = some.column("word").to_numpy().view(np.uint64), some.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def vocabulary(known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent words and their token ids."""
    hashes, n = known
    top = np.lexsort((hashes.view(np.int64), -n))[:TOP]
    order = np.argsort(hashes[top])
    return hashes[top][order], (order + 1).astype(np.int64)


def whole_counts(counts: DataFrame, vocab: tuple[np.ndarray, np.ndarray]) -> dict[int, int]:
    """The words of each hashed token, counted together."""
    top = counts.sparkSession.sparkContext.broadcast(vocab[0])  # TOP hashes

    def run(batches):
        for b in batches:
            h = b.column("word").to_numpy().view(np.uint64)
            rest = ~np.isin(h, top.value)
            n = np.bincount(hashed(h[rest]), b.column("n").to_numpy()[rest], VOCABULARY).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["token", "n"])

    sums = counts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # at most VOCABULARY rows
    return {r["token"]: r["n"] for r in sums}


def tokens_of(texts: pa.Array, vocab: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids with SIDE zeros around each text, each text's bounds in them, and
    the hashes of the words."""
    hashes, ids = vocab
    h, index, n = words_of(texts)
    token = hashed(h)
    if len(hashes) and len(h):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        token = np.where(hashes[at] == h, ids[at], token)
    out = np.zeros(len(index) + SIDE * (len(n) + 1), dtype=np.int64)
    ends = np.cumsum(n)
    lead = SIDE * (1 + np.arange(len(n)))
    at = np.arange(len(index)) + np.repeat(lead, n)
    words = np.zeros(len(out), dtype=np.uint64)
    out[at], words[at] = (token[index], h[index]) if len(h) else (0, 0)
    return out, np.stack([ends - n + lead, ends + lead]), words


class Network:
    """Parameters as float32 arrays; ``flat`` and ``from_flat`` move them."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.p = arrays

    @classmethod
    def fresh(cls, seed: int = 11) -> "Network":
        rng = np.random.default_rng(seed)
        p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
        p["gates"] += 1
        p["members"][:], p["classes"][:] = 0, 0
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in NAMES])

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> "Network":
        p, at = {}, 0
        for k in NAMES:
            size = int(np.prod(SHAPES[k]))
            p[k] = flat[at : at + size].reshape(SHAPES[k]).astype(np.float32)
            at += size
        return cls(p)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.p["bias"] + (self.p["inputs"][around] * self.p["gates"]).sum(axis=1)
        return np.concatenate([np.tanh(h), np.ones((len(h), 1), np.float32)], axis=1)

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        h = self.hidden(around)
        group, member = np.divmod(target, MEMBERS)
        out = _log_softmax(h @ self.p["classes"])[np.arange(len(h)), group]
        for rows, c in _by_class(group):
            out[rows] += _log_softmax(h[rows] @ self.p["members"][c])[np.arange(len(rows)), member[rows]]
        return out

    def step(self, around: np.ndarray, target: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the mean log-probability of a batch."""
        n, h = len(target), self.hidden(around)
        group, member = np.divmod(target, MEMBERS)
        d_class = np.exp(_log_softmax(h @ self.p["classes"]))
        d_class[np.arange(n), group] -= 1
        back = d_class @ self.p["classes"].T
        d_members = np.zeros_like(self.p["members"])
        for rows, c in _by_class(group):
            d = np.exp(_log_softmax(h[rows] @ self.p["members"][c]))
            d[np.arange(len(rows)), member[rows]] -= 1
            d_members[c] = h[rows].T @ d
            back[rows] += d @ self.p["members"][c].T
        back = back[:, :-1] * (1 - h[:, :-1] ** 2)
        near = self.p["inputs"][around]
        to_inputs = (back[:, None, :] * self.p["gates"]).reshape(-1, WIDTH)
        flat = around.ravel()
        d_inputs = np.stack([np.bincount(flat, to_inputs[:, k], VOCABULARY) for k in range(WIDTH)], axis=1)
        grads = {
            "inputs": d_inputs, "gates": (near * back[:, None, :]).sum(axis=0), "bias": back.sum(axis=0),
            "classes": h.T @ d_class, "members": d_members,
        }
        for k in NAMES:
            g = (grads[k] / n).astype(np.float32)
            squares[k] += g * g
            self.p[k] -= RATE * g / (np.sqrt(squares[k]) + 1e-6)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _by_class(group: np.ndarray):
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if cuts[c + 1] > cuts[c]:
            yield order[cuts[c] : cuts[c + 1]], c


_AROUND = np.array([k for k in range(-SIDE, SIDE + 1) if k])
PART = 2048


def targets(lo: np.ndarray, hi: np.ndarray, offset: np.ndarray) -> list[np.ndarray]:
    """The masked positions of each pass: together every position of every text once."""
    return [np.concatenate([np.arange(a + (o + k) % STRIDE, z, STRIDE) for a, z, o in zip(lo, hi, offset)]) for k in range(STRIDE)] if len(lo) else []


def train_round(part: DataFrame, vocab, net: Network, n_shards: int) -> Network:
    """Averages the networks trained on the shards of ``part``."""
    shared = part.sparkSession.sparkContext.broadcast((vocab, net.flat()))  # fixed size

    def run(batches):
        begin_task()
        vocab, flat = shared.value
        total, all_seen, now, own, squares, seen = np.zeros(len(flat)), 0, None, None, None, 0
        for b in shard_steps(batches):
            shard = b.column("shard")[0].as_py()
            if shard != now:
                if own is not None:
                    total += own.flat().astype(np.float64) * seen
                    all_seen += seen
                now, own, seen = shard, Network.from_flat(flat), 0
                squares = {k: np.zeros_like(own.p[k]) for k in NAMES}
            tokens, (lo, hi), _ = tokens_of(b.column("text"), vocab)
            for masked in targets(lo, hi, b.column("offset").to_numpy()):
                for at in range(0, len(masked), BATCH):
                    some = masked[at : at + BATCH]
                    own.step(tokens[some[:, None] + _AROUND], tokens[some], squares)
                seen += len(masked)
        if own is not None:
            total += own.flat().astype(np.float64) * seen
            all_seen += seen
        if all_seen:
            cuts = range(0, len(total), PART)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // PART for i in cuts], pa.int32()), pa.array([all_seen] * len(cuts), pa.int64()),
                 pa.array([total[i : i + PART].tobytes() for i in cuts], pa.binary())],
                ["part", "seen", "sums"],
            )

    def add(batches):
        total: dict[int, list] = {}
        for b in batches:
            for part, seen, raw in zip(*(b.column(c).to_pylist() for c in ("part", "seen", "sums"))):
                one = total.setdefault(part, [0, 0.0])
                one[0] += seen
                one[1] = one[1] + np.frombuffer(raw)
        for part, (seen, sums) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["part", "seen", "sums"])

    schema = "part int, seen long, sums binary"
    order = F.xxhash64("doc_id", "text", F.lit(2))
    dealt = part.select("text", F.pmod(F.xxhash64("text"), F.lit(STRIDE)).alias("offset"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)).alias("shard"), order.alias("turn"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "turn")
    rows = dealt.mapInArrow(run, schema).repartition("part").sortWithinPartitions("part", "seen", "sums").mapInArrow(add, schema).orderBy("part").collect()  # one network
    if not rows:
        return net
    return Network.from_flat(np.concatenate([np.frombuffer(r["sums"]) / r["seen"] for r in rows]))


def shard_steps(batches):
    """The rows of each shard in portions that depend on the shard alone: cut
    where its texts pass a multiple of ``STEP_BYTES``."""
    now, at, held = None, 0, []
    for b in batches:
        shards = b.column("shard").to_numpy()
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).tolist()
        lo = 0
        for i, (shard, size) in enumerate(zip(shards.tolist(), sizes)):
            if shard != now or at // STEP_BYTES != (at + size) // STEP_BYTES:
                held.append(b.slice(lo, i - lo))
                lo = i
                if any(x.num_rows for x in held):
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
                if shard != now:
                    now, at = shard, 0
            at += size
        held.append(b.slice(lo))
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass
class Model:
    """The network, its vocabulary, and the counts of words: those of the most
    frequent at hand, those of all as a table, and those of each hashed token."""

    net: Network
    vocab: tuple[np.ndarray, np.ndarray]
    known: tuple[np.ndarray, np.ndarray]
    whole: dict[int, int]
    counts: DataFrame


def train(docs: DataFrame) -> Model:
    counts = Workspace(docs.sparkSession, "lm").table(count_words(docs), "words")
    known = known_words(counts)
    vocab, net = vocabulary(known), Network.fresh()
    n_shards = max(1, -(-docs.count() // (SHARD_DOCS * ROUNDS)))
    turn = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(ROUNDS))
    for k in range(ROUNDS):  # together the rounds cover every document
        net = train_round(docs.where(turn == k), vocab, net, n_shards)
    return Model(net, vocab, known, whole_counts(counts, vocab), counts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (summed, natural log) and its mean."""
    spark = docs.sparkSession
    # at most KNOWN words; the rest is of fixed size
    shared = spark.sparkContext.broadcast((model.vocab, model.net.flat(), model.whole, model.known))

    def run(batches):
        begin_task()
        vocab, flat, whole, (known, n_known) = shared.value
        net, log_known = Network.from_flat(flat), np.log(n_known.astype(np.float64))
        # one more, so that a word never counted has a share too
        whole_of = np.log([1.0 + whole.get(k, 0) for k in range(VOCABULARY)])
        for batch in batches:
            for b in text_slices(batch, limit=1 << 20):
                tokens, (lo, hi), words = tokens_of(b.column("text"), vocab)
                inside = np.flatnonzero(tokens)
                log_p = np.zeros(len(tokens) + 1)
                for at in range(0, len(inside), 4 * BATCH):
                    some = inside[at : at + 4 * BATCH]
                    log_p[some + 1] = net.log_probability(tokens[some[:, None] + _AROUND], tokens[some])
                rare = np.flatnonzero(tokens > TOP)
                log_p[1 + rare] -= whole_of[tokens[rare]]
                seek = words[rare]
                if len(known):
                    at = np.minimum(np.searchsorted(known, seek), len(known) - 1)
                    hit = known[at] == seek
                    log_p[1 + rare[hit]] += log_known[at[hit]]
                    rare, seek = rare[~hit], seek[~hit]
                run_of = np.cumsum(log_p)
                total, n = run_of[hi] - run_of[lo], hi - lo
                offsets = np.append(np.searchsorted(rare, lo), len(rare)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("doc_id"), pa.array(n), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), pa.array(seek.view(np.int64)))],
                    ["row", "doc_id", "n_tokens", "part", "rare"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # written, so a row keeps its number
    scored = Workspace(spark, "lm").table(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, part double, rare array<long>"), "scored")
    # a word seen once adds log 1: only those seen more often need the join
    again = model.counts.where("n > 1")
    counted = scored.select("row", F.explode("rare").alias("word")).join(again.hint("merge"), "word")
    added = counted.groupBy("row").agg(F.sum(F.log(F.col("n").cast("double"))).alias("added"))
    whole = F.col("part") + F.coalesce("added", F.lit(0.0))
    return scored.drop("rare").join(added.hint("merge"), "row", "left").select(
        "doc_id", "n_tokens", whole.alias("log_likelihood"), (whole / F.greatest("n_tokens", F.lit(1))).alias("mean_log_likelihood")
    )


def op8_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, train(docs))
