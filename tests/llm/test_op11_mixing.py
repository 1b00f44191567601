import duckdb
import pytest
from pyspark.sql import functions as F

from barlane.llm import op11_mixing as op

SOURCES = "source string, source_size long, weight double"


def fill(spark, rows, **kw):
    got = op.water_fill(spark.createDataFrame([(s, n, float(w)) for s, n, w in rows], SOURCES), **kw).collect()
    return {r["source"]: r["target"] for r in got}


def plain_fill(rows, share, most):
    """Clamp one source at a time, the one that is fullest."""
    left, budget, out = {s: (n, w) for s, n, w in rows if n and w}, share * sum(n for _, n, _ in rows), {s: 0.0 for s, _, _ in rows}
    while left:
        level = budget / sum(w for _, w in left.values())
        s, (n, w) = min(left.items(), key=lambda x: x[1][0] / x[1][1])
        if most * n > w * level:
            return out | {s: w * level for s, (_, w) in left.items()}
        out[s] = most * n
        budget -= most * n
        del left[s]
    return out


@pytest.mark.parametrize("rows", [
    [("a", 100, 3), ("b", 100, 1), (None, 100, 2)],
    [("a", 1, 3), ("b", 1000, 1), ("c", 10, 2), ("d", 0, 5), ("e", 7, 0)],
    [(f"s{i}", 3**i, 1 + i % 3) for i in range(12)],
    [("a", 0, 1)],
    [],
])
def test_water_fill_is_that_of_one_clamp_at_a_time(spark, rows):
    for share, most in ((1.5, 2), (0.3, 2), (5.0, 2), (1.0, 1)):
        got, want = fill(spark, rows, share=share, most=most), plain_fill(rows, share, most)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-9), (share, most, s)


def test_weights_repeat_by_code_points_with_null_last(spark):
    names = ["b", "a", "é", "Z", "", None, "\U0001d11e", "ﬀ"]
    got = op.weighted(spark.createDataFrame([(s, 1, 1) for s in names], "source string, source_size long, n_rows long").repartition(3), (3, 1, 2))
    want = [s for s in sorted((s for s in names if s is not None))] + [None]
    assert {r["source"]: r["weight"] for r in got.collect()} == {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(want)}
    table = spark.createDataFrame([("a", 2.0), (None, 7.0)], "source string, weight double")
    got = op.weighted(spark.createDataFrame([(s, 1, 1) for s in names], "source string, source_size long, n_rows long"), table)
    assert {r["source"]: r["weight"] for r in got.collect()} == {s: {"a": 2.0, None: 7.0}.get(s, 0.0) for s in names}


def mixed(docs, **kw):
    got = op.mix(docs, op.n_words(F.col("text")), **kw)
    return got, got.select("doc_id", "text", "source", "mix.*").collect()


def key(r):
    return repr((r["doc_id"], r["size"], r["times"], r["target"], r["source"]))


def test_all_rows_return_and_sources_come_near_their_targets(spark, docs, doc_rows):
    sources = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "y"))
    got, rows = mixed(sources.withColumn("mix", F.lit(1)))
    assert len(rows) == len(doc_rows) and set(got.columns) == {*docs.columns, "mix"}
    for s in ("x", "y", None):
        of = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in of) == of[0]["source_size"]
        assert abs(sum(r["size"] * r["times"] for r in of) - of[0]["target"]) <= max(r["size"] for r in of) / 2 + 1e-6
        assert all(r["times"] <= 2 and r["target"] <= 2 * r["source_size"] for r in of)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert all(r["times"] == 0 for r in rows if not r["size"])
    again = mixed(sources.repartition(7))[1]
    assert sorted(map(key, rows)) == sorted(map(key, again))
    other = mixed(sources, seed=5)[1]
    assert sorted(map(key, rows)) != sorted(map(key, other))
    assert op.repeated(got).count() == sum(r["times"] for r in rows)


def test_copies_of_one_row_are_taken_as_far_as_the_rest_goes(spark):
    rows = spark.createDataFrame([(1, "a b c d", "s")] * 1000, "doc_id long, text string, source string").repartition(6)
    got = mixed(rows, share=1.25)[1]
    assert sum(r["times"] for r in got) == 1250 and {r["times"] for r in got} == {1, 2}


def test_empty(spark, empty):
    assert mixed(empty)[1] == []


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    got = op.op11_mixing(spark, sf_dir)
    want = con.execute(op.SQL).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op.op11_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "InPandas"))
