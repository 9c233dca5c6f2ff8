"""Fuzzy line deduplication.

Lines are normalised (lower case, letters and digits only).  Lines of at least
``MIN_WORDS`` words, or of ``MIN_CHARS`` letters and digits whatever their
words (scripts without blanks), take part.  Two distinct normalised lines link when their
edit similarity (1 - distance / longer length) is at least ``SIMILARITY`` and
they are candidates: they meet in one of ``TABLES`` tables and their 64-bit
SimHashes over runs of ``GRAM`` bytes differ in at most ``MAX_BITS`` bits.
Of every connected group of lines, equal ones included, the first occurrence
(by doc_id, text, line number) stays and the others are dropped.

Lines meet in a table when ``ROWS`` MinHashes of these runs are
equal.  What this finds of all similar lines is measured in the README.
Meeting places are sent packed, many lines to a row, by buckets of about
``BUCKET_BYTES``.  Within a place links are verified until the lines are
connected, never listed as pairs, and two lines are compared only in the first
table in which they meet.  Texts of candidates are fetched, and documents
rewritten, behind a bit filter of fixed size: what it lets pass is joined
exactly.

Nulls: a null text stays null; a null doc_id comes first.  Rows with the same
doc_id and text are one document and are cleaned alike; ties between
occurrences go to the smaller (doc_id, row key, line number).  Texts of any
length are taken whole.  Columns of any name are carried along.  A text whose lines
all go becomes empty.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.arrow import begin_task, string_bytes, text_slices
from quillon.llm.common import Workspace, components, documents, own_names

MIN_WORDS = 4
MIN_CHARS = 12
#: Bytes of a gram; MinHashes of a table and tables; SimHash radius.
GRAM = 7
ROWS, TABLES = 3, 16
MAX_BITS = 22
SIMILARITY = 0.8
#: Bits of the filters that are broadcast (4 MB), whatever the input.
FILTER_BITS = 1 << 25


def mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def string_hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each string of a null-free large_string array."""
    data, bounds = string_bytes(values)
    return span_hashes(data, bounds[:-1], np.diff(bounds), seed)


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    counts = (sizes + 7) >> 3  # words of eight bytes
    first = np.cumsum(counts) - counts
    within = 8 * (np.arange(int(counts.sum())) - np.repeat(first, counts))
    word = words_at(data)[np.repeat(starts, counts) + within]
    over = np.flatnonzero(counts)  # the last word of each span may be cut
    last, left = first[over] + counts[over] - 1, (sizes[over] - 8 * (counts[over] - 1)).astype(np.uint64)
    word[last] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
    each = mix(mix(word) + (within.astype(np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))
    run = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
    return mix(run[first + counts] - run[first] + sizes.astype(np.uint64))


def span_checks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span and its size, as one number."""
    out = sizes.astype(np.uint64) << np.uint64(32)
    some = np.flatnonzero(sizes)
    word = words_at(data)[starts[some]]
    short = np.maximum(64 - 8 * sizes[some], 0).astype(np.uint64)
    out[some] ^= mix(word & (np.uint64(0xFFFFFFFFFFFFFFFF) >> short))
    return out


#: Lower-case letters and digits stay, other ASCII becomes a blank; bytes of
#: longer characters stay here.
_PLAIN = np.array([c if chr(c).isalnum() or c > 127 else 32 for c in range(256)], dtype=np.uint8)


def large_strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def normalised(lines: pa.Array) -> pa.Array:
    """Lower case, letters and digits only, words one blank apart."""
    lines = pc.utf8_lower(lines)
    odd = pc.match_substring_regex(lines, r"[^\x00-\x7F\pL\pN]")  # other signs than ASCII's
    if pc.any(odd).as_py():
        lines = pc.if_else(odd, pc.replace_substring_regex(pc.if_else(odd, lines, pa.scalar("", pa.large_string())), r"[^\pL\pN]+", " "), lines)
    data, bounds = string_bytes(lines)
    data = _PLAIN[data]
    blank = data == 32
    again = np.empty_like(blank)  # a blank, or the line's begin, goes before
    again[1:], again[:1] = blank[:-1], True
    again[bounds[:-1][bounds[:-1] < len(data)]] = True
    keep = ~(blank & again)
    run = np.concatenate([[0], np.cumsum(keep)])
    data, bounds = data[keep], run[bounds]
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    last = last[data[last] == 32]
    keep = np.ones(len(data), dtype=bool)
    keep[last] = False
    return large_strings(data[keep], bounds - np.searchsorted(last, bounds))


_ONES = np.uint64(0x0101010101010101)


#: Features worked on at once, so that they stay in the processor's cache.
PORTION = 1 << 16


def portions(starts: np.ndarray):
    """Ranges of runs of about ``PORTION`` features; ``starts`` ends with the total."""
    at = np.searchsorted(starts, np.arange(0, starts[-1] + PORTION, PORTION)).clip(max=len(starts) - 1)
    at = np.unique(at).tolist()
    return zip(at[:-1], at[1:])


def simhash(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of each run of 64-bit features; ``starts`` ends with the total."""
    parts = [_simhash(features[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]) for lo, hi in portions(starts)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def _simhash(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = np.diff(starts)
    pieces = -(-counts // 255)  # byte counters hold 255 features
    owner = np.repeat(np.arange(len(counts)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(starts[:-1], pieces) + 255 * within
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    if len(begin):
        lanes = np.empty_like(features)
        for k in range(8):  # bit k of each byte, in eight byte counters
            np.right_shift(features, np.uint64(k), out=lanes)
            np.bitwise_and(lanes, _ONES, out=lanes)
            part = np.add.reduceat(lanes, begin).view(np.uint8).reshape(-1, 8)
            if len(owner) == len(counts):
                ones[:, k::8] = part
            else:
                np.add.at(ones[:, k::8], owner, part.astype(np.int64))
    bits = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text index, line number, normalised line) of the lines that take part."""
    lines = pc.split_pattern(texts, "\n")
    counts = np.diff(lines.offsets.to_numpy())
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = normalised(lines.flatten())
    data, bounds = string_bytes(flat)
    blanks = np.concatenate([[0], np.cumsum(data == 32)])
    words = np.where(np.diff(bounds) > 0, 1 + blanks[bounds[1:]] - blanks[bounds[:-1]], 0)
    chars = pc.utf8_length(flat).to_numpy() - np.maximum(words - 1, 0)  # without the blanks between words
    take = np.flatnonzero((words >= MIN_WORDS) | (chars >= MIN_CHARS))
    return owner[take], number[take], flat.take(pa.array(take))


def grams(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all GRAM-byte runs of each line, and where each line starts; a
    shorter line is one run of its own."""
    data, bounds = string_bytes(lines)
    counts = np.maximum(np.diff(bounds) - GRAM + 1, 1)
    starts = np.concatenate([[0], np.cumsum(counts)])
    whole = words_at(data) & np.uint64((1 << 8 * GRAM) - 1)
    inside = np.ones(len(data), dtype=bool)
    for k in range(1, GRAM):  # no run begins at a line's last bytes, but at its first
        late = bounds[1:] - k
        inside[late[late > bounds[:-1]]] = False
    code = whole[inside]
    short = np.flatnonzero(np.diff(bounds) < GRAM)
    if len(short):
        code[starts[short]] &= (np.uint64(1) << (np.uint64(8) * np.diff(bounds)[short].astype(np.uint64))) - np.uint64(1)
    return mix(code), starts


_RANDOM = np.random.default_rng(5).integers(0, 1 << 32, (TABLES * ROWS, 2), dtype=np.uint32)


def meeting_places(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each line its place in each table: lines x TABLES."""
    if len(starts) < 2:
        return np.zeros((0, TABLES), dtype=np.uint64)
    out = np.empty((len(starts) - 1, TABLES), dtype=np.uint64)
    for lo, hi in portions(starts):
        high = (features[starts[lo] : starts[hi]] >> np.uint64(32)).astype(np.uint32)
        begin, part = starts[lo:hi] - starts[lo], np.empty_like(high)
        for t in range(TABLES):
            place = np.full(hi - lo, t, dtype=np.uint64)
            for factor, flips in _RANDOM[t * ROWS : (t + 1) * ROWS]:
                np.multiply(high, factor | np.uint32(1), out=part)
                np.bitwise_xor(part, flips, out=part)
                place = mix(place ^ np.minimum.reduceat(part, begin).astype(np.uint64))
            out[lo:hi, t] = place
    return out


def line_sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, line number, key, SimHash) of the lines that take part."""
    owner, number, flat = lines_of(texts)
    return owner, number, string_hashes(flat, 1), simhash(*grams(flat))


def _longest(most: int, equal) -> int:
    """The largest k up to ``most`` for which ``equal`` holds, if it does below."""
    lo, hi = 0, most
    while lo < hi:
        k = (lo + hi + 1) // 2
        lo, hi = (k, hi) if equal(k) else (lo, k - 1)
    return lo


def _trimmed(a: str, b: str, similarity: float) -> bool | tuple[str, str, int]:
    """The answer where bounds settle it; else what lies between a common begin
    and end, and how many edits are allowed."""
    longer = max(len(a), len(b))
    # round() guards the product against binary fractions
    allowed = int(round((1 - similarity) * longer, 9))
    if abs(len(a) - len(b)) > allowed:
        return False
    most = min(len(a), len(b))
    lo = _longest(most, lambda k: a[:k] == b[:k])
    end = _longest(most - lo, lambda k: a[len(a) - k :] == b[len(b) - k :])
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if max(len(a), len(b)) <= allowed:  # at most so many edits
        return True
    if not a or not b:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y) if p != q) <= allowed:
        return True  # word by word
    return a, b, allowed


def edit_similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least ``similarity``."""
    found = _trimmed(a, b, similarity)
    return found if isinstance(found, bool) else _within(*found)


def _within(a: str, b: str, allowed: int) -> bool:
    """Whether at most ``allowed`` edits lead from a to b, by Myers' bit vectors:
    one big integer per column."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        eq = where.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        h_plus = (minus | ~(d | plus)) & full
        h_minus = plus & d
        if h_plus & top:
            distance += 1
        elif h_minus & top:
            distance -= 1
        if distance - left > allowed:  # each column left takes one off at most
            return False
        h_plus = ((h_plus << 1) | 1) & full
        h_minus = (h_minus << 1) & full
        plus = (h_minus | ~(x | h_plus)) & full
        minus = h_plus & x
    return distance <= allowed


#: Longest strings whose distances are taken together; characters of one side of
#: a portion, and the words of eight bytes of its table of places.
TOGETHER_CHARS, TOGETHER, TOGETHER_WORDS = 3000, 1 << 20, 1 << 21
#: Portions of fewer pairs for each word of the band are taken one by one.
LONE = 10


def all_similar(pairs: list[tuple[str, str]], similarity: float = SIMILARITY) -> np.ndarray:
    """``edit_similar`` of many pairs."""
    out, left = np.zeros(len(pairs), dtype=bool), []
    for k, (a, b) in enumerate(pairs):
        found = _trimmed(a, b, similarity)
        if isinstance(found, bool):
            out[k] = found
        elif max(len(found[0]), len(found[1])) > TOGETHER_CHARS:
            out[k] = _within(*found)
        else:
            left.append((max(len(found[0]), len(found[1])), k, *found))
    left.sort(key=lambda x: (-(x[4].bit_length()), -x[0]))  # bands alike, then lengths
    marks = np.array([(x[4].bit_length(), x[0]) for x in left]).reshape(-1, 2)
    at = 0
    while at < len(left):
        alike = (marks[at:, 0] == marks[at, 0]) & (3 * marks[at:, 1] >= 2 * marks[at, 1])  # True up to a point
        some = left[at : at + min(int(alike.sum()), max(1, TOGETHER // left[at][0]))]
        out[[x[1] for x in some]] = _all_within([x[2] for x in some], [x[3] for x in some], np.array([x[4] for x in some]))
        at += len(some)
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and the texts' lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.array([len(x) for x in texts])


def _all_within(a: list[str], b: list[str], allowed: np.ndarray) -> np.ndarray:
    """``_within`` of many pairs by Myers' bit vectors, all pairs in step: 64 rows
    of the table of distances to a word, and of each column only the words that
    touch a band about the diagonal.  Cells beyond the band count as far, which
    no path of at most ``allowed`` edits meets."""
    n = len(a)
    (left, rows), (right, columns) = _codes(a), _codes(b)
    n_words, longest = -(-int(rows.max()) // 64), int(columns.max())
    spare = (allowed - np.abs(rows - columns)) // 2  # of the edits, those that may lead away and back
    above, below = int((np.maximum(columns - rows, 0) + spare).max()), int((np.maximum(rows - columns, 0) + spare).max())
    if n < LONE * min(n_words, 2 + (above + below) // 64):
        return np.array([_within(*x) for x in zip(a, b, allowed.tolist())])
    used = np.zeros(int(max(left.max(), right.max())) + 1, dtype=bool)
    used[left] = True
    code = np.where(used, np.cumsum(used), 0)  # 0: not in any a
    letters = int(used.sum()) + 1
    if n * letters * n_words > TOGETHER_WORDS:
        half = n // 2
        return np.concatenate([_all_within(a[:half], b[:half], allowed[:half]), _all_within(a[half:], b[half:], allowed[half:])])

    def owners(sizes):
        return np.repeat(np.arange(n), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    # places[w, pair, letter]: the rows of word w that hold the letter
    places = np.zeros((n_words, n * letters), dtype=np.uint64)
    pair, at = owners(rows)
    np.add.at(places.reshape(-1), (at >> 6) * (n * letters) + pair * letters + code[left], np.uint64(1) << (at & 63).astype(np.uint64))
    pair, at = owners(columns)
    met = np.repeat(np.arange(n)[None, :] * letters, longest, axis=0)
    met[at, pair] += code[right]

    one, high = np.uint64(1), np.uint64(63)
    plus, minus = np.full((n_words, n), ~np.uint64(0)), np.zeros((n_words, n), dtype=np.uint64)
    alive, out = np.arange(n), np.zeros(n, dtype=bool)
    eq, xv, x, up, down, carry_up, carry_down = np.empty((7, n), dtype=np.uint64)
    inside = np.clip(rows[None, :] - 64 * np.arange(n_words)[:, None], 0, 64).astype(np.uint64)
    inside = np.where(inside == 64, ~np.uint64(0), (one << (inside & high)) - one)  # rows of each a
    ends = np.zeros(longest + 1, dtype=bool)
    ends[columns] = True
    for j in range(1, longest + 1):
        carry_up.fill(1)
        carry_down.fill(0)
        for w in range(max(0, (j - above - 1) // 64), min(n_words, (j + below - 1) // 64 + 1)):
            p, m = plus[w], minus[w]
            np.take(places[w], met[j - 1], out=eq, mode="clip")
            np.bitwise_or(eq, m, out=xv)
            np.bitwise_or(eq, carry_down, out=eq)
            np.bitwise_and(eq, p, out=x)
            np.add(x, p, out=x)
            np.bitwise_xor(x, p, out=x)
            np.bitwise_or(x, eq, out=x)
            np.bitwise_or(x, p, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, m, out=up)
            np.bitwise_and(p, x, out=down)
            np.right_shift(up, high, out=eq)  # on to the next word
            np.left_shift(up, one, out=up)
            np.bitwise_or(up, carry_up, out=up)
            np.copyto(carry_up, eq)
            np.right_shift(down, high, out=eq)
            np.left_shift(down, one, out=down)
            np.bitwise_or(down, carry_down, out=down)
            np.copyto(carry_down, eq)
            np.bitwise_or(xv, up, out=p)
            np.invert(p, out=p)
            np.bitwise_or(p, down, out=p)
            np.bitwise_and(up, xv, out=m)
        if ends[j]:
            k = np.flatnonzero(columns == j)
            more, less = (np.bitwise_count(x[:, k] & inside[:, k]).sum(axis=0, dtype=np.int64) for x in (plus, minus))
            out[alive[k]] = j + more - less <= allowed[k]
        if j % 64 == 0 and j < longest:
            stay = (columns > j) & (_least(plus, minus, rows, columns, j) <= allowed)
            if not stay.any():
                break
            if stay.sum() <= 0.8 * len(alive):
                alive, rows, columns, allowed = alive[stay], rows[stay], columns[stay], allowed[stay]
                plus, minus, inside, met = (np.compress(stay, x, axis=1) for x in (plus, minus, inside, met))
                eq, xv, x, up, down, carry_up, carry_down = np.empty((7, len(alive)), dtype=np.uint64)
    return out


def _least(plus: np.ndarray, minus: np.ndarray, rows: np.ndarray, columns: np.ndarray, j: int) -> np.ndarray:
    """A lower bound of each pair's distance after column j: the least cell and
    the least way on, from every eighth row; between two of them either falls
    by four at most."""
    step = np.bitwise_count(plus.view(np.uint8)).astype(np.int16) - np.bitwise_count(minus.view(np.uint8)).astype(np.int16)
    step = step.reshape(len(plus), -1, 8).transpose(1, 0, 2).reshape(len(rows), -1)
    here = np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(step, axis=1)], axis=1) + j
    row = 8 * np.arange(here.shape[1])
    return (here + np.abs((rows[:, None] - row) - (columns[:, None] - j))).min(axis=1) - 8


def bit_filter(keys: DataFrame, column: str, places=None) -> np.ndarray:
    """A filter of fixed size: a set bit for each key's two positions."""
    places = keys.select(F.explode(F.array(*(places or spots)(column))).alias("p"))
    words = places.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v")
    ).toPandas()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return out


def spots(column: str) -> list:
    """A key's two positions in a filter."""
    return [F.pmod(F.xxhash64(column, F.lit(s)), F.lit(FILTER_BITS)) for s in (1, 2)]


def hash_spots(column: str) -> list:
    """The positions of a key that is a hash itself; ``spots_of`` in numpy."""
    return [F.shiftrightunsigned(column, 64 - 25 * s).bitwiseAND(F.lit(FILTER_BITS - 1)) for s in (1, 2)]


def spots_of(keys: np.ndarray) -> list[np.ndarray]:
    return [((keys.view(np.uint64) >> np.uint64(64 - 25 * s)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for s in (1, 2)]


def hits(bits: np.ndarray, *positions: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter: false is for sure."""
    out = np.ones(len(positions[0]), dtype=bool)
    for x in positions:
        out &= ((bits[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return out


def passes(spark: SparkSession, bits: np.ndarray, rows: DataFrame, column: str, name: str = "_pass") -> DataFrame:
    """Adds ``name``: false for sure where the key was never in the filter."""
    shared = spark.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes

    @F.pandas_udf("boolean")
    def inside(p, q):
        import pandas as pd

        return pd.Series(hits(shared.value, p.to_numpy(np.int64), q.to_numpy(np.int64)))

    return rows.withColumn(name, inside(*spots(column)))


ROW_KEY = "xxhash64(doc_id, text)"


def occurrences(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, line, key) of every line that takes part."""

    def run(batches):
        begin_task()
        for whole in batches:
            for b in text_slices(whole):
                texts = pc.fill_null(b.column("text"), "").cast(pa.large_string())
                owner, number, flat = lines_of(texts)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [b.column("rk").take(at), b.column("doc_id").take(at), pa.array(number.astype(np.int32)), pa.array(string_hashes(flat, 1).view(np.int64))],
                    ["rk", "doc_id", "line", "key"],
                )

    rows = docs.select(F.expr(ROW_KEY).alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "rk long, doc_id long, line int, key long")


#: A line at a meeting place.
_MEETING = np.dtype([("block", "<u8"), ("key", "<i8"), ("sim", "<u8"), ("size", "<i4")])
#: Bytes of a bucket of meeting places, and of what a task packs at once.
BUCKET_BYTES, PACK_BYTES = 16 << 20, 24 << 20


def meetings(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, raw): every line that takes part, once a table, as packed
    ``_MEETING`` records; a line that a slice of texts repeats is sent once."""

    def packed(parts):
        rows = np.concatenate(parts)
        bucket = ((rows["block"] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = np.append(first, len(rows)) * _MEETING.itemsize
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(rows[order])])
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][first].astype(np.int64)), raw.cast(pa.binary())], ["bucket", "raw"])

    def run(batches):
        begin_task()
        parts, held = [], 0
        for whole in batches:
            for b in text_slices(whole, limit=2 << 20):
                flat = lines_of(pc.fill_null(b.column("text"), "").cast(pa.large_string()))[2].unique()
                features, starts = grams(flat)
                rows = np.empty((len(flat), TABLES), dtype=_MEETING)
                rows["block"] = meeting_places(features, starts)
                rows["key"] = string_hashes(flat, 1).view(np.int64)[:, None]
                rows["sim"] = simhash(features, starts)[:, None]
                rows["size"] = pc.utf8_length(flat).to_numpy()[:, None]
                if len(flat):
                    parts.append(rows.ravel())
                    held += parts[-1].nbytes
                if held > PACK_BYTES:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return docs.select("text").mapInArrow(run, "bucket long, raw binary")


def _buckets(batches):
    """The records of each bucket, sorted by place and line, each line once a place."""
    now, parts = None, []
    for b in batches:
        for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("raw")):
            if bucket != now and parts:
                yield _sorted(parts)
                parts = []
            now = bucket
            parts.append(np.frombuffer(raw.as_buffer(), dtype=_MEETING))
    if parts:
        yield _sorted(parts)


def _sorted(parts: list[np.ndarray]) -> np.ndarray:
    """Without what is alone at its place, which is nearly all."""
    rows = np.concatenate(parts)
    block = np.ascontiguousarray(rows["block"])
    order = np.argsort(block)
    equal = np.diff(block[order]) == 0
    some = np.zeros(len(rows), dtype=bool)
    some[1:] |= equal
    some[:-1] |= equal
    rows = rows[order[some]]
    rows = rows[np.lexsort((rows["key"], rows["block"]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows["block"][1:] != rows["block"][:-1]) | (rows["key"][1:] != rows["key"][:-1])
    return rows[new]


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, norm, places) of the lines whose key is in ``wanted``, once each;
    ``places`` holds 32 bits of the line's place in each table."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "key", hash_spots))  # FILTER_BITS / 8 bytes

    def run(batches):
        begin_task()
        for whole in batches:
            for b in text_slices(whole, limit=2 << 20):
                flat = lines_of(pc.fill_null(b.column("text"), "").cast(pa.large_string()))[2].unique()
                key = string_hashes(flat, 1)
                may = np.flatnonzero(hits(bits.value, *spots_of(key)))
                flat = flat.take(pa.array(may))
                places = meeting_places(*grams(flat)).astype("<u4")
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * TABLES), len(flat), [None, pa.py_buffer(places)])
                yield pa.RecordBatch.from_arrays([pa.array(key[may].view(np.int64)), flat.cast(pa.string()), raw.cast(pa.binary())], ["key", "norm", "places"])

    found = docs.select("text").mapInArrow(run, "key long, norm string, places binary").dropDuplicates(["key"])
    return found.join(wanted.select("key").distinct(), "key", "left_semi")


def _groups(batches, columns: list[str], by: list[str]):
    """Complete groups from sorted batches, as dicts of columns."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(columns)
        held = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
        if not held.num_rows:
            continue
        marks = [held.column(c).to_numpy() for c in by]
        new = np.zeros(held.num_rows, dtype=bool)
        for m in marks:
            new[1:] |= m[1:] != m[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield held.slice(0, last), np.flatnonzero(new[:last])
        held = held.slice(last)
    if held is not None and held.num_rows:
        yield held, np.zeros(0, np.int64)


def _together(groups, rows: int):
    """Tables of complete groups joined until they hold that many rows."""
    held, n = [], 0
    for table, _ in groups:
        held.append(table)
        n += table.num_rows
        if n >= rows:
            yield pa.concat_tables(held)
            held, n = [], 0
    if held:
        yield pa.concat_tables(held)


def _bounds(table: pa.Table, by: list[str]) -> list[tuple[int, int]]:
    """Groups of more than one row."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for c in by:
        m = table.column(c).to_numpy()
        new[1:] |= m[1:] != m[:-1]
    starts = np.append(np.flatnonzero(new), table.num_rows)
    many = np.flatnonzero(np.diff(starts) > 1)
    return [(int(starts[i]), int(starts[i + 1])) for i in many]


#: Rows of meeting places whose pairs are compared together.
TOGETHER_ROWS = 1 << 16


def _near(sims: np.ndarray, sizes: np.ndarray):
    """Pairs (i, j), i < j, of a group whose SimHashes are near and whose lengths
    allow the similarity; in blocks of rows, so memory is linear in the group."""
    n = len(sims)
    step = max(1, (1 << 20) // max(n, 1))
    for at in range(0, n, step):
        x = sims[at : at + step, None] ^ sims[None, :]
        i, j = np.nonzero(np.bitwise_count(x) <= MAX_BITS)
        i += at
        own = (j > i) & _fit(sizes[i], sizes[j])
        yield i[own], j[own]


#: Groups up to this size are paired all at once, by the distance of their rows.
FEW = 16


def _near_pairs(block: np.ndarray, sims: np.ndarray, sizes: np.ndarray):
    """``_near`` over all groups of sorted rows: pairs of rows, in portions."""
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(block)))
    last, few = np.repeat(starts + counts, counts), np.repeat(counts <= FEW, counts)
    i = np.flatnonzero(few)
    for step in range(1, FEW):
        i = i[i + step < last[i]]
        if not len(i):
            break
        ok = _may_pair(sims[i] ^ sims[i + step], sizes[i], sizes[i + step])
        yield i[ok], i[ok] + step
    for lo, n in zip(starts[counts > FEW].tolist(), counts[counts > FEW].tolist()):
        for a, b in _near(sims[lo : lo + n], sizes[lo : lo + n]):
            yield lo + a, lo + b


def _fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the shorter length allows the similarity."""
    return np.minimum(a, b) >= np.ceil(np.round(np.maximum(a, b) * SIMILARITY, 6))


def _may_pair(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(bits) <= MAX_BITS) & _fit(a, b)


def dedup_lines(docs: DataFrame, count_name: str = "n_dropped") -> DataFrame:
    """All columns of ``docs`` with repeated lines gone from ``text``, and their
    number under ``count_name``, which replaces a column of that name."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "line_dedup")
    found = work.table(occurrences(docs), "lines")
    place = F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "rk", "line")
    lines = work.table(found.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")), "distinct")

    n_buckets = max(1, -(-lines.count() * TABLES * _MEETING.itemsize // BUCKET_BYTES))
    met = meetings(docs, n_buckets).repartition("bucket").sortWithinPartitions("bucket")

    def candidates(batches):
        begin_task()
        for rows in _buckets(batches):
            if not len(rows):
                continue
            near, sims, sizes = np.zeros(len(rows), dtype=bool), np.ascontiguousarray(rows["sim"]), np.ascontiguousarray(rows["size"])
            for i, j in _near_pairs(np.ascontiguousarray(rows["block"]), sims, sizes):
                near[i] = near[j] = True
            rows = rows[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c]).view(np.int64)) for c in ("block", "key", "sim")] + [pa.array(np.ascontiguousarray(rows["size"]))], ["block", "key", "sim", "size"])

    near = work.table(met.mapInArrow(candidates, "block long, key long, sim long, size int"), "near")
    # both sides grow with the input: the same plan at every size
    meeting = near.join(candidate_texts(docs, near).hint("merge"), "key").repartition("block").sortWithinPartitions("block", "key")

    def verify(batches):
        begin_task()
        for table in _together(_groups(batches, ["block", "key", "sim", "size", "norm", "places"], ["block"]), TOGETHER_ROWS):
            a, b, waiting, held = [], [], [], 0
            sims, keys = table.column("sim").to_numpy().view(np.uint64), table.column("key").to_numpy()
            sizes, blocks = table.column("size").to_numpy(), table.column("block").to_numpy().view(np.uint64)
            texts, same = table.column("norm").to_pylist(), np.arange(len(keys))
            places = np.frombuffer(b"".join(table.column("places").to_pylist()), "<u4").reshape(-1, TABLES)
            here = (places == blocks.astype(np.uint32)[:, None]).argmax(axis=1)  # the table they meet in
            earlier = np.arange(TABLES) < here[:, None]
            new = np.append(True, blocks[1:] != blocks[:-1])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            ends = np.append(starts[1:], len(blocks))

            def compare():
                """Compares waiting pairs until each is one connected group or told apart."""
                p, q = (np.concatenate(x) for x in zip(*waiting))
                waiting.clear()
                order = np.argsort(q, kind="stable")
                p, q, most = p[order], q[order], 1
                while len(p):
                    apart = same[p] != same[q]
                    p, q = p[apart], q[apart]
                    first = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) < most)  # of each line's pairs
                    most *= 2  # once in the first round, then twice as often
                    for k in first[all_similar([(texts[x], texts[y]) for x, y in zip(p[first].tolist(), q[first].tolist())])].tolist():
                        x, y = int(p[k]), int(q[k])
                        if same[x] != same[y]:
                            part = same[starts[group[x]] : ends[group[x]]]
                            part[part == same[y]] = same[x]
                            a.append(keys[x])
                            b.append(keys[y])
                    rest = np.ones(len(p), dtype=bool)
                    rest[first] = False
                    p, q = p[rest], q[rest]

            for i, j in _near_pairs(blocks, sims, sizes):
                fresh = ~((places[i] == places[j]) & earlier[i]).any(axis=1)  # else compared there
                waiting.append((i[fresh], j[fresh]))
                held += len(i)
                if held > 1 << 16:
                    compare()
                    held = 0
            if waiting:
                compare()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = work.table(meeting.mapInArrow(verify, "a long, b long"), "links")
    work.drop("near")
    groups = components(links, work)
    # Only lines that repeat or link can lose an occurrence.
    grouped = lines.join(groups.withColumnRenamed("node", "key"), "key", "left").where("n > 1 or component is not null")
    grouped = grouped.select("key", "first", F.coalesce("component", "key").alias("component"))
    stay = grouped.groupBy("component").agg(F.min("first").alias("stay"))
    fate = grouped.join(stay, "component").select("key", "stay")
    gone = found.join(fate, "key").where("not (rk = stay.rk and line = stay.line)")
    drops = work.table(gone.groupBy(F.col("rk").alias("rk")).agg(F.collect_set("line").alias("lines")), "drops")
    work.drop("lines", "distinct", "links")

    docs = docs.drop(count_name)
    rk, inside, lost = own_names(docs, "rk", "pass", "lost")
    tagged = passes(spark, bit_filter(drops, "rk"), docs.withColumn(rk, F.expr(ROW_KEY)), rk, inside)
    clean = tagged.where(~F.col(inside)).drop(rk, inside).withColumn(count_name, F.lit(0))
    drops = drops.select(F.col("rk").alias(rk), F.col("lines").alias(lost))
    some = tagged.where(inside).drop(inside).join(drops.hint("merge"), rk, "left").drop(rk)

    def rewrite(batches):
        for b in batches:
            names = b.schema.names
            texts, gone = b.column(names.index("text")).to_pylist(), b.column(names.index(lost)).to_pylist()
            for i, numbers in enumerate(gone):
                if numbers is not None:
                    numbers = set(numbers)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in numbers)
            arrays = [pa.array(texts, b.column(k).type) if c == "text" else b.column(k) for k, c in enumerate(names) if c != lost]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(x or ()) for x in gone], pa.int32())], [*(c for c in names if c != lost), count_name])

    return clean.unionByName(some.mapInArrow(rewrite, clean.schema))


def op7_line_dedup(spark, sf_dir):
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
