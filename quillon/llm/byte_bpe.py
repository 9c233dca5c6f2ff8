"""Exact, cached byte-level BPE encoding with the ``tokenizers`` library.

The pre-tokenizer of a byte-level vocabulary never lets a token cross from a
non-blank character to a following blank, so a text falls apart into pieces
(a word with the one blank before it) that encode independently of their
neighbours.  Each distinct piece is encoded once per worker; a text's ids are
then a gather over its pieces.  New pieces of a slice are merged together: in
each step every word takes its merge of the lowest rank, the leftmost of equals.

The result equals ``Tokenizer.encode(text, add_special_tokens=False)``; with
``encode_special_tokens`` the vocabulary's special tokens are text like any
other, as that setting of the library says.  Texts whose blanks touch one
another or that hold an added token, and pieces outside plain Latin words, go
through the library's whole path.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.llm.arrow import begin_task, string_bytes
from quillon.llm.line_dedup import span_checks, span_hashes

#: Entries of a worker's caches (about 50 bytes a piece, 150 a stem): when they
#: are full, pieces that were not met since the last time go.
CACHE_ENTRIES = 500_000

#: A line break at most, letters, then marks without the apostrophe: two
#: pre-tokens at most.
_PLAIN = r"^\n?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]*[!-&(-/:-@\[-`{-~]*$"
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """The merge rules of a byte-level vocabulary, applied to many words at once."""

    NONE = np.int32(np.iinfo(np.int32).max)
    #: Longest words of each batch, in symbols; longer ones go to the library.
    WIDTHS = (4, 8, 12, 16, 24, 48)

    def __init__(self, model: dict, symbols: dict[int, str]):
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        _, last = np.unique(keys[::-1], return_index=True)  # of a pair named twice the later rank holds
        rank = len(keys) - 1 - last
        order = np.argsort(keys[rank])
        self.keys, self.rank = keys[rank][order], rank[order].astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.first = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int32)

    @classmethod
    def of(cls, tok, symbols: dict[int, str]) -> "Merges | None":
        """None where the vocabulary has rules beyond plain merges."""
        model = json.loads(tok.to_str())["model"]
        extra = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or any(model.get(k) for k in extra) or not set(symbols.values()) <= model["vocab"].keys():
            return None
        return cls(model, symbols)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where there is no rule or no symbol (-1)."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], self.NONE)

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of spans of bytes, with a space before where ``spaced``: all ids
        end to end, how many of each, and which spans are too long."""
        whole = sizes + spaced
        counts, found, lo = np.zeros(len(starts), np.int64), [], 0
        for width in self.WIDTHS:
            some = np.flatnonzero((whole > lo) & (whole <= width))
            lo = width
            if len(some):
                column = np.arange(width)
                at = column - spaced[some, None]
                inside = (at >= 0) & (at < sizes[some, None])
                grid = np.full(inside.shape, -1, dtype=np.int32)
                grid[inside] = self.first[data[(starts[some, None] + at)[inside]]]
                grid[spaced[some], 0] = self.first[32]
                done = self._merge(grid)
                counts[some] = (done >= 0).sum(axis=1)
                found.append((some, done[done >= 0]))
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u4")
        for some, ids in found:
            out[spread(first[some], counts[some])] = ids
        return out, counts, whole > lo

    def _merge(self, grid: np.ndarray) -> np.ndarray:
        n, width = grid.shape
        ranks = np.full((n, width), self.NONE)  # of the pair that begins at each symbol; the last begins none
        ranks[:, :-1] = self._ranks(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(n, width - 1)
        done, rows, column = grid.copy(), np.arange(n), np.arange(width - 1, dtype=np.int16)
        while len(rows):
            at = ranks.argmin(axis=1)
            k = np.arange(len(rows))
            best = ranks[k, at]
            left = best != self.NONE
            if not left.all():
                done[rows[~left]] = grid[~left]
                rows, grid, ranks, at, best = rows[left], grid[left], ranks[left], at[left], best[left]
                k = np.arange(len(rows))
            if not len(rows):
                break
            grid[k, at] = self.made[best]
            later = column >= at[:, None].astype(np.int16)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=later)
            later[k, at] = False
            np.copyto(grid[:, :-1], grid[:, 1:].copy(), where=later & (column > at[:, None]))
            grid[:, -1], ranks[:, -1] = -1, self.NONE
            for shift in (-1, 0):
                some = np.flatnonzero((at + shift >= 0) & (at + shift < width - 1))
                j = at[some] + shift
                ranks[some, j] = self._ranks(grid[some, j], grid[some, j + 1])
        return done


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of spans, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceCache:
    """Ids of pieces in arrays: sorted hashes, a check of each (its first eight
    bytes and its size), and where its ids lie in one store."""

    def __init__(self, entries: int):
        self.entries = entries
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.store, self.end = np.zeros(1 << 16, "<u4"), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of each piece's ids, and which are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = (self.keys[at] == keys) & (self.checks[at] == checks)
        self.met[at[there]] = True
        return self.starts[at], self.sizes[at], there

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Stores new pieces, their ids end to end; their starts."""
        starts = self.end + np.cumsum(sizes) - sizes
        if self.end + len(ids) > len(self.store):
            self.store = np.concatenate([self.store[: self.end], np.zeros(max(len(ids), self.end), "<u4")])
        self.store[self.end : self.end + len(ids)] = ids
        self.end += len(ids)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        for name, new in (("keys", keys), ("checks", checks), ("starts", starts), ("sizes", sizes), ("met", np.ones(len(keys), bool))):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))
        return starts

    def trim(self) -> None:
        """Before a slice: drops what was not met since the last time, if full."""
        if len(self.keys) <= self.entries:
            return
        if self.met.sum() > self.entries:
            return self._clear()
        sizes = self.sizes[self.met]
        ids, ends = self.store[spread(self.starts[self.met], sizes)], np.cumsum(sizes)
        self.keys, self.checks, self.starts, self.sizes = self.keys[self.met], self.checks[self.met], ends - sizes, sizes
        self.store, self.end, self.met = ids, len(ids), np.zeros(len(sizes), bool)


class ByteBpe:
    """Encodes string arrays to id arrays; null texts encode as empty."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, encode_special_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = encode_special_tokens
        self.n_ids = self.tok.get_vocab_size(with_added_tokens=True)
        added = self.tok.get_added_tokens_decoder().values()
        #: Texts with one of these take the library's whole path.
        self.added = [t.content for t in added if not (encode_special_tokens and t.special)]
        self.model = self.tok.model
        self.symbols = _byte_symbols()
        self.merges = Merges.of(self.tok, self.symbols)
        self.cache_entries = cache_entries
        self.newline = np.frombuffer(self._whole("\n"), "<u4")
        self.cache, self.stems = PieceCache(cache_entries), PieceCache(cache_entries)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _library(self, data: np.ndarray, start: int, size: int, spaced: bool) -> np.ndarray:
        """Ids of one pre-token by the library's own model."""
        shown = "".join(self.symbols[b] for b in [32] * int(spaced) + data[start : start + size].tolist())
        return np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4")

    def _stems(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pre-tokens lie in the stems' store, and how many."""
        self.stems.trim()
        keys = span_hashes(data, starts, sizes) ^ np.where(spaced, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        checks = span_checks(data, starts, sizes)
        at, counts, there = self.stems.find(keys, checks)
        lost = np.flatnonzero(~there)
        if len(lost):
            _, first, same = np.unique(keys[lost], return_index=True, return_inverse=True)
            new = lost[first]
            if self.merges:
                ids, n, long = self.merges(data, starts[new], sizes[new], spaced[new])
            else:
                ids, n, long = np.zeros(0, "<u4"), np.zeros(len(new), np.int64), sizes[new] + spaced[new] > 0
            if long.any():
                begin = np.cumsum(n) - n
                parts = [self._library(data, starts[new[i]], sizes[new[i]], spaced[new[i]]) if long[i] else ids[begin[i] : begin[i] + n[i]] for i in range(len(new))]
                ids, n = np.concatenate(parts), np.array([len(x) for x in parts])
            own = self.stems.add(keys[new], checks[new], ids, n)
            at[lost], counts[lost] = own[same], n[same]
        return at, counts

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces (a line break and a word, or a space and a word), end
        to end, and how many of each; words that differ in marks share their stem."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        some, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        data, bounds = string_bytes(words.take(pa.array(some)))
        broken = np.zeros(len(some), dtype=bool)
        full = bounds[1:] > bounds[:-1]
        broken[full] = data[bounds[:-1][full]] == 10
        begin, end = bounds[:-1] + broken, bounds[1:]
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        n_letters = letters[end] - letters[begin]
        marked = np.flatnonzero((n_letters > 0) & (end - begin > n_letters))
        sizes = np.where(n_letters > 0, n_letters, end - begin)
        at, counts = self._stems(
            data, np.concatenate([begin, (begin + n_letters)[marked]]), np.concatenate([sizes, (end - begin - n_letters)[marked]]),
            np.concatenate([~broken, np.zeros(len(marked), dtype=bool)]),
        )
        wholes = [np.frombuffer(self._whole(key if key[:1] == "\n" else " " + key), "<u4") for key in words.take(pa.array(odd)).to_pylist()]
        n = np.zeros(len(words), np.int64)
        lead = broken * len(self.newline)
        n[some] = lead + counts[: len(some)]
        n[some[marked]] += counts[len(some) :]
        n[odd] = [len(x) for x in wholes]
        first = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), "<u4")
        if len(self.newline):
            out[(first[some[broken]][:, None] + np.arange(len(self.newline))).ravel()] = np.tile(self.newline, int(broken.sum()))
        starts = np.concatenate([first[some] + lead, (first[some] + lead + counts[: len(some)])[marked]])
        out[spread(starts, counts)] = self.stems.store[spread(at, counts)]
        if wholes:
            out[spread(first[odd], n[odd])] = np.concatenate(wholes)
        return out, n

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array's texts, and where each text begins (n + 1 offsets)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        # Every piece is preceded by one blank; the break before the text is dropped below.
        odd = pc.match_substring_regex(texts, r"[\s\pZ\x{85}\v][\s\pZ\x{85}\v]").to_numpy(zero_copy_only=False).copy()
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        broken, none = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.binary_join_element_wise(broken, pc.replace_substring(texts, "\n", " \n"), none)
        lists = pc.split_pattern(marked, " ")
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        self.cache.trim()
        data, spans = string_bytes(words.dictionary)
        keys, checks = span_hashes(data, spans[:-1], np.diff(spans)), span_checks(data, spans[:-1], np.diff(spans))
        starts, lens, there = self.cache.find(keys, checks)
        new = np.flatnonzero(~there)
        if len(new):
            own, sizes = self._pieces(words.dictionary.take(pa.array(new)))
            starts[new], lens[new] = self.cache.add(keys[new], checks[new], own, sizes), sizes
        store = self.cache.store
        at = words.indices.to_numpy()
        n_ids, begin = lens[at], starts[at]
        first = offsets[:-1] - offsets[0]
        n_ids[first] -= len(self.newline)
        begin[first] += len(self.newline)
        ends = np.cumsum(n_ids)
        ids = store[spread(begin, n_ids)]
        bounds = np.concatenate([[0], ends])[np.append(first, len(at))]
        if odd.any():
            parts, sizes = [], np.diff(bounds)
            for i in range(n):
                part = ids[bounds[i] : bounds[i + 1]]
                if odd[i]:
                    part = np.frombuffer(self._whole(texts[i].as_py()), dtype="<u4")
                    sizes[i] = len(part)
                parts.append(part)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return ids, bounds


_OPEN: dict[tuple[str, bool], ByteBpe] = {}


def byte_bpe(path: str, cache_entries: int = CACHE_ENTRIES, encode_special_tokens: bool = False) -> ByteBpe:
    """The worker's encoder for a vocabulary file (kept between its own tasks)."""
    begin_task("byte_bpe", _OPEN.clear)
    if (path, encode_special_tokens) not in _OPEN:
        _OPEN[path, encode_special_tokens] = ByteBpe(path, cache_entries, encode_special_tokens)
    return _OPEN[path, encode_special_tokens]
