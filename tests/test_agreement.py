"""Cases where queries differed from their SQL."""

import itertools

import duckdb
import pytest

import __spark_entry__ as entry
from lexigrove.operators import links


@pytest.mark.parametrize("name", ["search_std", "search_flagship", "debug_parts"])
def test_words_of_the_band_that_begin_a_text_are_no_phrase(spark, tmp_path, name):
    """The two words stand in a fifth of the documents; one document begins with both, so they are a name of the dictionary too."""
    texts = [f"x{k} y{k} z{k} plain {'aa' if k % 5 == 0 else ''} v{k} {'bb' if k % 5 < 1 and k else ''}. w{k}" for k in range(40)] + ["aa bb cc dd"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    entry.queries()["forward_features"](spark, str(tmp_path)).count()
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    assert want and got == want


def test_sums_of_links_do_not_depend_on_the_order_of_rows(spark):
    """Each sum is 26.844885, a half at five digits; added in some orders, doubles make it 26.844884999999998."""
    orders = list(itertools.permutations([1.465141, 4.810819, 1.600131, 7.614552, 1.618144, 9.736098]))[::9]
    near = spark.createDataFrame([(6 * i + k, f"x{i}", 1.0) for i in range(len(orders)) for k in range(6)], "doc_id long, link string, weight double").coalesce(1)
    ranks = spark.createDataFrame([(6 * i + k, s) for i, o in enumerate(orders) for k, s in enumerate(o)], "doc_id long, score double").coalesce(1)
    rows = links.aggregated(near, ranks).collect()
    assert len(rows) == 80 and {(r["weight"], r["n_refs"]) for r in rows} == {(26.844885, 6)}
