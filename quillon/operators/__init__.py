"""Relational operators: block statistics, logical codecs, reshaping, diff and patch."""
