"""Language identification by a byte convolutional network.

Texts are lower-cased, taken as UTF-8 and cut into windows of ``LENGTH`` bytes
that cover them whole.  Bytes are embedded, filters of several widths run over
each window, the maximum of each filter is kept, and softmax over those gives
the window's languages.  A text's language is the one with the largest sum of
log-probabilities over its windows, weighted by the bytes in them.

The network is trained in numpy on the driver, on a bounded sample: at most
``SAMPLE`` windows of each label, drawn by a hash of the document's id from
all labelled rows.  Prediction sees the text alone.

Nulls: a text that is null or holds no letter is ``und`` with score 0; rows
with null labels are never learnt from.  Without any labelled text every row
is ``und``.  Repeated rows each get their prediction; of labels that tie the
first in order is taken.  Texts of any length are read whole.  Columns of any
name are carried along; the new ones replace columns of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.arrow import begin_task, string_bytes, text_slices
from quillon.llm.common import documents

UNDETERMINED = "und"
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Windows learnt from per label, and windows taken of one document.
SAMPLE = 2000
WINDOWS_PER_DOC = 2
EPOCHS, BATCH, RATE = 8, 64, 0.004
#: Steps of training at least, so that a small sample is learnt as well.
STEPS = 1000


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING; byte 0 pads
    filters: np.ndarray  # (widest * EMBEDDING) x (len(WIDTHS) * FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # filters x labels
    shift: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded neighbourhood of each position: n x LENGTH x (widest * EMBEDDING)."""
        widest = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, widest - 1)))
        e = self.embedding[padded]
        return np.concatenate([e[:, k : k + LENGTH] for k in range(widest)], axis=2)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), dtype=np.float32)
        for at in range(0, len(windows), BATCH):
            x = self.columns(windows[at : at + BATCH])
            peak = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(len(x), LENGTH, -1).max(axis=1)
            z = np.maximum(peak + self.bias, 0) @ self.weights + self.shift
            z -= z.max(axis=1, keepdims=True)
            out[at : at + BATCH] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over whole texts, the text of each, and the bytes in each."""
    data, bounds = string_bytes(texts)
    sizes = np.diff(bounds)
    counts = -(-sizes // LENGTH)
    owner = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    filled = np.minimum(LENGTH, sizes[owner] - within * LENGTH)
    starts = (np.cumsum(sizes) - sizes)[owner] + within * LENGTH
    index = starts[:, None] + np.arange(LENGTH)
    inside = np.arange(LENGTH) < filled[:, None]
    data = np.append(data, np.zeros(LENGTH, np.uint8))
    return np.where(inside, data[np.minimum(index, len(data) - 1)], 0).astype(np.uint8), owner, filled


def training_windows(docs: DataFrame, label: str, sample: int) -> list[tuple[str, int, bytes]]:
    """At most ``sample`` windows per label, by the smallest hashes of ids."""

    def draw(batches):
        begin_task()
        best: dict[str, list] = {}
        for whole in batches:
            labels, order = whole.column("label").to_pylist(), whole.column("priority").to_pylist()
            rows = sorted(range(len(labels)), key=order.__getitem__)
            taken: dict[str, int] = {}
            keep = []
            for i in rows:
                if taken.get(labels[i], 0) < sample:
                    taken[labels[i]] = taken.get(labels[i], 0) + 1
                    keep.append(i)
            for part in text_slices(whole.take(pa.array(keep, pa.int64()))):
                windows, owner, filled = windows_of(lowered(part.column("text")))
                names, prior = part.column("label").to_pylist(), part.column("priority").to_pylist()
                first = np.searchsorted(owner, np.arange(len(names) + 1))
                for i, (name, p) in enumerate(zip(names, prior)):
                    own = np.flatnonzero(filled[first[i] : first[i + 1]] >= min(LENGTH // 4, filled[first[i] : first[i + 1]].max(initial=0)))
                    for k in range(min(WINDOWS_PER_DOC, len(own))):
                        w = own[(p + k * 7919) % len(own)] if k else own[p % len(own)]
                        best.setdefault(name, []).append((p, k, windows[first[i] + w].tobytes()))
            for name in best:
                best[name] = sorted(best[name])[:sample]
        rows = [(name, p, k, w) for name, own in best.items() for p, k, w in own]
        if rows:
            names, p, k, w = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(p, pa.int64()), pa.array(k, pa.int32()), pa.array(w, pa.binary())],
                ["label", "priority", "k", "bytes"],
            )

    rows = docs.select(F.col(label).alias("label"), F.xxhash64("doc_id", label).alias("priority"), "text")
    rows = rows.where("text is not null and label is not null")
    # Hashes below a share of their range hold the smallest ones: twice the
    # documents that the sample needs, however many there are.
    counts = rows.where("text <> ''").groupBy("label").count().collect()  # one row per label
    if not counts:
        return []
    edges = [(r["label"], int(-(2**63) + min(1.0, 2 * sample / r["count"]) * (2**64 - 2**11))) for r in counts]
    edge = F.element_at(F.create_map(*[c for name, e in edges for c in (F.lit(name), F.lit(e).cast("long"))]), F.col("label"))
    drawn = rows.where(F.col("priority") <= edge).mapInArrow(draw, "label string, priority long, k int, bytes binary")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("priority", "k", "bytes"))
    return [tuple(r) for r in drawn.withColumn("r", rank).where(F.col("r") <= sample).select("label", "priority", "bytes").orderBy("priority", "label", "bytes").collect()]


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, seed: int = 7) -> Network | None:
    """A network for the labels of ``docs``, or None without labelled text."""
    rows = training_windows(docs, label, sample)
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    x = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(-1, LENGTH)
    y = np.array([labels.index(r[0]) for r in rows])
    rng = np.random.default_rng(seed)
    widest, n_filters = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.zeros((widest * EMBEDDING, n_filters), dtype=np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
    normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    net = Network(
        labels, normal(256, EMBEDDING) * 0.5, normal(widest * EMBEDDING, n_filters) * mask * 0.3,
        np.zeros(n_filters, np.float32), normal(n_filters, len(labels)) * 0.1, np.zeros(len(labels), np.float32),
    )
    names = ["embedding", "filters", "bias", "weights", "shift"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    share = np.bincount(y, minlength=len(labels))
    weight = (share.sum() / (len(labels) * share)).astype(np.float32)
    step, epochs = 0, max(EPOCHS, -(-STEPS // -(-len(x) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            n, step = len(some), step + 1
            cols = net.columns(x[some])
            conv = (cols.reshape(-1, cols.shape[2]) @ net.filters).reshape(n, LENGTH, n_filters)
            top = conv.argmax(axis=1)
            peak = np.take_along_axis(conv, top[:, None, :], axis=1)[:, 0] + net.bias
            hidden = np.maximum(peak, 0)
            z = hidden @ net.weights + net.shift
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[some]] -= 1
            p *= weight[y[some]][:, None] / n
            back = (p @ net.weights.T) * (peak > 0)
            at_top = np.take_along_axis(cols, top[:, :, None], axis=1)  # n x filters x (widest * EMBEDDING)
            to_columns = back[:, :, None] * net.filters.T[None]
            near = np.pad(x[some], ((0, 0), (0, widest - 1)))
            bytes_at = near[np.arange(n)[:, None, None], top[:, :, None] + np.arange(widest)]
            d_embedding = np.zeros_like(net.embedding)
            np.add.at(d_embedding, bytes_at.reshape(-1), to_columns.reshape(-1, EMBEDDING))
            grads = {
                "embedding": d_embedding,
                "filters": np.einsum("nf,nfk->kf", back, at_top) * mask,
                "bias": back.sum(axis=0),
                "weights": hidden.T @ p,
                "shift": p.sum(axis=0),
            }
            rate = RATE * (1 - epoch / epochs)
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
                setattr(net, k, (getattr(net, k) - rate * change).astype(np.float32))
    return net


def predict(docs: DataFrame, net: Network | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and the prediction and its score under ``names``,
    which replace columns of those names."""
    docs, outputs = docs.drop(*names), names

    def run(batches):
        begin_task()
        for whole in batches:
            for b in text_slices(whole, limit=1 << 20):
                names, scores = [UNDETERMINED] * len(b), np.zeros(len(b))
                if net is not None:
                    texts = lowered(b.column("text"))
                    lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                    windows, owner, filled = windows_of(texts)
                    log_p = net.log_probabilities(windows).astype(np.float64)
                    share = filled[:, None].astype(np.float64)
                    total = np.zeros((len(b), len(net.labels)))
                    mass, size = np.zeros_like(total), np.zeros((len(b), 1))
                    np.add.at(total, owner, log_p * share)
                    np.add.at(mass, owner, np.exp(log_p) * share)
                    np.add.at(size, owner, share)
                    best = total.argmax(axis=1)
                    p = np.clip(mass[np.arange(len(b)), best] / np.maximum(size[:, 0], 1), 0, 1)
                    scores = np.where(lettered, p, 0.0)
                    names = [net.labels[k] if ok else UNDETERMINED for k, ok in zip(best, lettered)]
                arrays = [b.column(c) for c in b.schema.names] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, *outputs])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{outputs[0]}` string, `{outputs[1]}` double")


def held_out(doc_id: Column) -> Column:
    """Documents never learnt from: crc32 of the id as text leaves 2 of 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    net = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
