"""Driver contract: entry runs, queries and oracles line up."""
import re

import __spark_entry__ as E

def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if not re.match(r"op\d+_|pipeline$", k)}  # the optional subpackage checks its own
    learned = {"forest_predictions", "forest_drivers"}  # a model's values: compared with second evaluations in the model tests
    assert own - learned == own & set(o)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "p_brand_te" in df.columns
