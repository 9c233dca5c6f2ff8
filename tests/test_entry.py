"""The driver contract."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_need_the_training_data_operators():
    code = "import sys; sys.modules['quillon.llm'] = None; import quillon.catalog, quillon.catalog_bytes, quillon.streaming.sessions, quillon.sources.frames"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
