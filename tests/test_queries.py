"""Every registered query with SQL gives the rows that SQL gives."""

import pytest

from quillon import catalog, catalog_bytes, catalog_relational, catalog_session  # noqa: F401
from tests.oracle import DATA, rows, tables


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = tables().execute(catalog.ORACLES[name]).df()
    assert rows(got) == rows(want)


def test_byte_encoder_selects_as_the_plan_does(spark):
    by_bytes = catalog.QUERIES["selected_codecs"](spark, DATA)
    by_plan = catalog.QUERIES["profile_int_blocks_orders"](spark, DATA).select("block", "n", "codec")
    assert rows(by_bytes.toPandas()) == rows(by_plan.toPandas())


def test_fnv_hash(spark):
    got = {r.n_nationkey: r.hash for r in catalog.QUERIES["fnv_dictionary_hash"](spark, DATA).collect()}
    assert len(got) == 25 and len(set(got.values())) == 25
