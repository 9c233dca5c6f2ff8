"""Sequence packing by shortest-pack-first over the length histogram.

Documents become token ids plus an end id and are cut into pieces of at most
``max_tokens``.  Only the histogram of piece lengths (at most ``max_tokens``
numbers) reaches the driver, which places lengths longest first, always into
the emptiest kind of pack that still has room, keeping counts per packing
pattern.  Pieces then find their pack by their rank within their length.

Nulls: a null text packs as its end id alone; a null doc_id is kept.  Empty
tables give empty results; repeated rows are packed once each, and pieces that
tie in every column take their ranks in any order.  Texts of any length are cut
whole.  Only doc_id and text are read; other columns take no part.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.arrow import begin_task, text_slices
from quillon.llm.byte_bpe import byte_bpe
from quillon.llm.common import Workspace, documents, salted_slots, tokenizer_file

MAX_TOKENS = 2048
#: Words cached per worker and generation; packing shares workers with other stages.
CACHE_ENTRIES = 150_000
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False, encode_special_tokens: bool = False) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds their little-endian ids."""

    def pieces(batches):
        encoder = byte_bpe(tokenizer, CACHE_ENTRIES, encode_special_tokens)
        for whole in batches:
            for batch in text_slices(whole, limit=2 << 20):
                ids, bounds = encoder.encode_array(batch.column("text"))
                rows: list[list] = [[] for _ in range(6 if with_ids else 5)]
                for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                    own = np.append(ids[lo:hi], end_id).astype("<u4")
                    for at in range(0, len(own), max_tokens):
                        piece = own[at : at + max_tokens].tobytes()
                        row = (doc, at, len(piece) // 4, zlib.crc32(piece), len(own), piece)
                        for column, value in zip(rows, row):
                            column.append(value)
                kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(rows, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


@dataclass
class Plan:
    """Slots by (length, first rank): ranks lo.. go to sequences base.. at offset."""

    length: np.ndarray
    lo: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> Plan:
    """Shortest-pack-first: counts of patterns, longest lengths first.

    Every step ends a length or a pattern, so there are at most twice as many
    patterns as lengths, whatever the number of pieces.
    """
    open_packs: list[tuple[int, int, int, tuple[int, ...]]] = []  # (-room, tie, count, pattern)
    tie = 0
    done: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown = []
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, count, pattern = heapq.heappop(open_packs)
                room = -room
                used = min(count, left)
                if count > used:
                    heapq.heappush(open_packs, (-room, tie := tie + 1, count - used, pattern))
            else:
                room, used, pattern = max_tokens, left, ()
            left -= used
            grown.append((room - length, used, pattern + (length,)))
            # A pack may take this length again: it competes at once.
            room, used, pattern = grown.pop()
            if room:
                heapq.heappush(open_packs, (-room, tie := tie + 1, used, pattern))
            else:
                done.append((used, pattern))
    done += [(count, pattern) for _, _, count, pattern in sorted(open_packs)]
    slots, base, taken = [], 0, dict.fromkeys(histogram, 0)
    for count, pattern in done:
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], base, offset))
            taken[length] += count
            offset += length
        base += count
    columns = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences=base)


def place(pieces: DataFrame, max_tokens: int = MAX_TOKENS, n_salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    packs = plan(histogram, max_tokens)
    wide = np.int64(1) << 44
    keys = packs.length * wide + packs.lo
    ranked = salted_slots(pieces, "length", ["doc_id", "start", "ids_crc32"], ["doc_id", "start", "ids_crc32"], "_rank", n_salts)
    columns = pieces.columns

    def assign(batches):
        begin_task()
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            slot = np.searchsorted(keys, length * wide + rank, side="right") - 1
            sequence = packs.base[slot] + rank - packs.lo[slot]
            arrays = [b.column(c) for c in columns] + [pa.array(sequence), pa.array(packs.offset[slot])]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(assign, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False, encode_special_tokens: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.table(cut(docs, tokenizer, max_tokens, end_id, with_ids, encode_special_tokens), "pieces")
    return place(pieces, max_tokens)


def op2_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
