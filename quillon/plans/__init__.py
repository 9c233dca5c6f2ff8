"""Codec selection: deterministic rules over block statistics."""
