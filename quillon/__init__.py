"""Columnar encoding analytics on Spark.

Values and sessions are at hand here; plans over DataFrames are in
``quillon.operators``, ``plans``, ``sources`` and ``streaming``.
"""

from quillon.functions.dynamic import decode, encode
from quillon.functions.wire import UnknownReference, WireError
from quillon.operators.session import Decoder, Encoder, Field, Schema, Unsigned
from quillon.options import SessionOptions, encode_batch, encode_bound_stream, encode_with_schema

__all__ = [
    "Decoder", "Encoder", "Field", "Schema", "SessionOptions", "UnknownReference", "Unsigned", "WireError",
    "decode", "encode", "encode_batch", "encode_bound_stream", "encode_with_schema",
]
