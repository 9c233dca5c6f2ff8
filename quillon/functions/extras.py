"""Optional layers that the format's text describes: bit-grouped record bodies,
zero packing, fixed vocabularies, blob pools and block compression."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from quillon.functions import wire as W

# Thresholds of the selection rules.
ZERO_SHARE, ZERO_SHARE_STRONG, ZERO_LEAST = 0.25, 0.5, 16
COMPRESS_LEAST = 256


def _width(f) -> int | None:
    """Bits of a field in the bit group, or None for a byte payload."""
    if f.family() == "bool":
        return 1
    if f.enum:
        return (len(f.enum) - 1).bit_length()
    if f.family() in ("unsigned", "signed") and f.ranged():
        return (f.high - f.low).bit_length()
    return None


def encode_body(schema, record: dict) -> bytes:
    """Presence bits, the bit group, then byte payloads, in schema order.
    Values outside a declared range or set are errors."""
    present = [f for f in schema.fields if f.required or record.get(f.name) is not None]
    out = W.packed_flags([record.get(f.name) is not None for f in schema.fields if not f.required])
    group = shift = 0
    payload = bytearray()
    for f in present:
        v, width = record.get(f.name), _width(f)
        if v is None:
            raise W.WireError(f"missing required field {f.name}")
        if width is not None:
            code = int(v) if f.family() == "bool" else f.enum.index(v) if f.enum and v in f.enum else -1 if f.enum else v - f.low
            if not 0 <= code <= (1 if f.family() == "bool" else len(f.enum) - 1 if f.enum else f.high - f.low):
                raise W.WireError(f"{f.name} is out of its range")
            group |= code << shift
            shift += width
        elif f.family() == "f64":
            payload += struct.pack("<d", v)
        elif f.family() == "string":
            payload += W.string(v)
        elif f.family() == "binary":
            payload += W.blob(v)
        else:
            payload += W.varint(v if f.family() == "unsigned" else W.zigzag(v))
    return out + group.to_bytes(-(-shift // 8), "little") + bytes(payload)


def decode_body(schema, raw: bytes) -> dict:
    r = W.Reader(raw)
    flags = iter(r.flags(sum(not f.required for f in schema.fields), strict=True))
    present = [f for f in schema.fields if f.required or next(flags)]
    bits = sum(_width(f) or 0 for f in present)
    group = int.from_bytes(r.take(-(-bits // 8)), "little")
    out = {}
    for f in present:
        width = _width(f)
        if width is not None:
            code, group = group & (1 << width) - 1, group >> width
            if f.family() == "bool":
                out[f.name] = bool(code)
            elif code > (len(f.enum) - 1 if f.enum else f.high - f.low):
                raise W.WireError(f"{f.name} is out of its range")
            else:
                out[f.name] = f.enum[code] if f.enum else f.low + code
        elif f.family() == "f64":
            out[f.name] = struct.unpack("<d", r.take(8))[0]
        elif f.family() == "string":
            out[f.name] = r.string()
        elif f.family() == "binary":
            out[f.name] = r.blob()
        else:
            x = r.varint()
            out[f.name] = x if f.family() == "unsigned" else W.unzigzag(x)
    if group:
        raise W.WireError("bit group padding")
    r.end()
    return out


def zero_pack(data: bytes) -> bytes:
    """Length, then per 8 bytes a tag of the bytes that are not zero, and those."""
    words = np.frombuffer(data + bytes(-len(data) % 8), np.uint8).reshape(-1, 8)
    tags = np.packbits(words != 0, axis=1, bitorder="little")[:, 0]
    return W.varint(len(data)) + b"".join(bytes([t]) + w[w != 0].tobytes() for t, w in zip(tags.tolist(), words))


def zero_unpack(raw: bytes) -> bytes:
    r = W.Reader(raw)
    n = r.count()
    out = bytearray()
    while len(out) < n:
        tag = r.byte()
        literal = iter(r.take(tag.bit_count()))
        out += bytes(next(literal) if tag >> k & 1 else 0 for k in range(8))
    r.end()
    if any(out[n:]):
        raise W.WireError("zero packing padding")
    return bytes(out[:n])


def zero_packing_pays(data: bytes) -> bool:
    """At least a quarter zero bytes, in a payload that is not too small, and shorter."""
    return len(data) >= ZERO_LEAST and data.count(0) / len(data) >= ZERO_SHARE and len(zero_pack(data)) < len(data)


class Vocabulary:
    """A fixed, ordered vocabulary that both sides hold: words become ids."""

    def __init__(self, words: list[str]):
        self.words, self.ids = list(words), {w: i for i, w in enumerate(words)}

    def encode(self, text: str) -> bytes:
        """Id + 1, or 0 and the text for words outside."""
        return W.varint(self.ids[text] + 1) if text in self.ids else b"\x00" + W.string(text)

    def decode(self, r: W.Reader) -> str:
        code = r.varint()
        if code > len(self.words):
            raise W.UnknownReference("static_word", code - 1)
        return self.words[code - 1] if code else r.string()


def pool_blobs(blobs: list[bytes]) -> bytes:
    """Each distinct blob once, then one id per blob."""
    ids = {b: i for i, b in enumerate(dict.fromkeys(blobs))}
    return W.varint(len(ids)) + b"".join(map(W.blob, ids)) + W.varint(len(blobs)) + b"".join(W.varint(ids[b]) for b in blobs)


def unpool_blobs(raw: bytes) -> list[bytes]:
    r = W.Reader(raw)
    pool = [r.blob() for _ in range(r.count())]
    out = []
    for _ in range(r.count()):
        i = r.count()
        if i >= len(pool):
            raise W.WireError("pooled blob id")
        r.claim(len(pool[i]), 1)
        out.append(pool[i])
    r.end()
    return out


def _zstd():
    try:
        import zstandard
    except ModuleNotFoundError:  # then deflate stands in, and says so in the frame
        return None
    return zstandard


RAW, DEFLATE, ZSTD = 0, 1, 2


def compress(block: bytes) -> bytes:
    """A mode byte and the block, compressed where that is worth it."""
    if len(block) < COMPRESS_LEAST:
        return bytes([RAW]) + block
    z = _zstd()
    mode, coded = (ZSTD, z.ZstdCompressor(level=3).compress(block)) if z else (DEFLATE, zlib.compress(block, 6))
    return bytes([mode]) + coded if len(coded) < len(block) else bytes([RAW]) + block


def decompress(raw: bytes) -> bytes:
    mode, body = raw[0], raw[1:]
    if mode == RAW:
        return body
    if mode == DEFLATE:
        return zlib.decompressobj().decompress(body, W.MAX_COUNT * 8)
    if mode != ZSTD or _zstd() is None:
        raise W.WireError("compression mode")
    return _zstd().ZstdDecompressor().decompress(body, max_output_size=W.MAX_COUNT * 8)
