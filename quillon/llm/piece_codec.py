"""SentencePiece (merge type) encoding by prefix table, and decoding.

For merges by score, the encoding of every prefix of a text ends in one token
only: the automaton's match whose pair with the token before it is left alone
by the merges.  A table holds that last token for each prefix; the ids are
read off it backwards.  Each prefix costs its automaton matches, so a text
without blanks is as cheap per character as any other.

Texts fall apart before a blank that follows another character (no piece of
the vocabulary has a blank inside) and at line breaks (no piece has one); each
distinct part is encoded once per worker.

Nulls encode as empty; empty tables give empty results; every row counts.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillon.llm.arrow import begin_task, text_slices
from quillon.llm.common import documents, tokenizer_file

BLANK = "▁"
UNKNOWN_SURFACE = " ⁇ "
REPLACEMENT = "�".encode()
#: Entries kept per worker before the caches restart.
PART_ENTRIES, PAIR_ENTRIES = 300_000, 1_000_000

_PARTS = re.compile(rf"\n|{BLANK}*[^\n{BLANK}]+|{BLANK}+")


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.control = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(n) if i not in self.byte_of and i not in self.control and i != self.unknown]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.id_of):
            raise ValueError("pieces with inner blanks or line breaks are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:  # others never come out of merges
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[str, tuple[bytes, int, bytes]] = {}

    def merge(self, text: str) -> list[str]:
        """The merges themselves: highest score first, leftmost on ties."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, a: int, b: int) -> bool:
        """Whether merges leave the tokens a, b as they are, side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PAIR_ENTRIES:
                self.pairs.clear()
            left, right = self.pieces[a], self.pieces[b]
            known = self.pairs[a, b] = self.merge(left + right) == [left, right]
        return known

    def tokens(self, part: str) -> list[int]:
        """Ids of a part; a character outside the vocabulary gives its bytes."""
        last: list[int | None] = [None] * (len(part) + 1)  # by prefix length; None: unknown character
        size = [1] * (len(part) + 1)
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter(part):
            end += 1
            start = end - length
            if last[end] is None:
                before = last[start]
                if start == 0 or before is None:
                    fits = True
                else:
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = self.compatible(before, token)
                if fits:
                    last[end], size[end] = token, length
        ids, at = [], len(part)
        while at:
            token = last[at]
            if token is None:
                ids.extend(self.byte_id.get(b, self.unknown) for b in reversed(part[at - 1].encode()))
            else:
                ids.append(token)
            at -= size[at]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        return [i for part in _PARTS.findall(text) for i in self.tokens(part)]

    def decode(self, ids: list[int]) -> str:
        return self._decode(ids, True).decode()

    def _decode(self, ids: list[int], at_start: bool) -> bytes:
        out, run, begin = [], bytearray(), at_start
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                begin = False
                continue
            if run:
                out.append(_characters(bytes(run)))
                run = bytearray()
            if i in self.control:
                continue
            piece = UNKNOWN_SURFACE if i == self.unknown else self.pieces[i]
            if begin:
                piece = piece.removeprefix(BLANK)
            begin = False
            out.append(piece.replace(BLANK, " ").encode())
        if run:
            out.append(_characters(bytes(run)))
        return b"".join(out)

    def _part(self, key: str) -> tuple[bytes, int, bytes]:
        """Decimal ids, their count, and the decoded bytes of a key."""
        if key[:1] == "\n":
            ids = self.tokens("\n") + (self.tokens(key[1:]) if len(key) > 1 else [])
        else:
            ids = self.tokens(BLANK + key)
        return ",".join(map(str, ids)).encode(), len(ids), self._decode(ids, False)

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.or_(pc.match_substring_regex(texts, f"^ |  |{BLANK}"), pc.equal(texts, "")).to_pylist()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        if len(self.parts) > PART_ENTRIES:
            self.parts = {}
        parts, known = [], self.parts
        for k in words.dictionary.to_numpy(zero_copy_only=False).tolist():
            got = known.get(k)
            if got is None:
                got = known[k] = self._part(k)
            parts.append(got)
        names, counts, plain = zip(*parts) if parts else ((), (), ())
        counts, at = np.array(counts, dtype=np.int64), words.indices.to_numpy()
        out = []
        for i in range(len(texts)):
            if whole[i]:
                ids = self.encode(texts[i].as_py())
                joined, n, text = ",".join(map(str, ids)).encode(), len(ids), self._decode(ids, True)
            else:
                own = at[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]]
                n, own = int(counts[own].sum()), own.tolist()
                joined = b",".join([names[j] for j in own])
                text = b"".join([plain[j] for j in own])[1:]
            out.append((n, hashlib.sha256(joined).hexdigest(), hashlib.sha256(text).hexdigest()))
        return out


def _characters(run: bytes) -> bytes:
    """Byte tokens as text: each byte outside a character becomes U+FFFD."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                run[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(run[at : at + size])
            at += size
            break
        else:
            out.append(REPLACEMENT)
            at += 1
    return b"".join(out)


_OPEN: dict[str, PieceCodec] = {}


def piece_codec(path: str) -> PieceCodec:
    """The worker's codec for a model file (kept between its own tasks)."""
    begin_task("piece_codec", _OPEN.clear)
    if path not in _OPEN:
        _OPEN[path] = PieceCodec(path)
    return _OPEN[path]


def encode_column(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the ids of its whole text."""

    def run(batches):
        codec = piece_codec(model)
        for whole in batches:
            for b in text_slices(whole):
                ids = [codec.encode(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def digest_column(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, and digests of the ids and the decoded text."""

    def run(batches):
        codec = piece_codec(model)
        for whole in batches:
            for b in text_slices(whole):
                n, ids, text = zip(*codec.digests(b.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6_piece_codec(spark, sf_dir):
    return digest_column(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))
