"""The main table resamples as often as the studied analysis: 5,000 bootstraps and 9,999 randomisations, in code and SQL."""

from tandemlab.plans import registry


def test_main_table_draws_all_replicates(spark, smallest):
    sql = registry.SQL["h17_h21_main_table"]
    assert "range(0, 5000)" in sql and "range(0, 9999)" in sql and "range(0, 100)" not in sql
    p = [r["p"] for r in registry.QUERIES["h17_h21_main_table"](spark, smallest).select("p").collect()]
    # p-values are whole multiples of 1 / 10,000: with 100 replicates they were of 1 / 101
    assert p and all(abs(x * 10_000 - round(x * 10_000)) < 1e-3 for x in p) and any(x < 1 for x in p)
