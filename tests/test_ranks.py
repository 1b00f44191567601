"""Ranks and quantiles against pandas and NumPy, with ties, missing values, signs and every magnitude."""

import numpy as np
import pandas as pd
import pytest

from barlane.operators import ranks

GROUPS = {
    1: [0.0, -0.0, 1.5, 1.5, 1.5, -2.0, 1e-300, -1e300, float("inf"), float("-inf"), 5e-324, -5e-324],
    2: [None, None],
    3: [None, 4.0],
    4: [7.0] * 40 + [8.0],
    5: list(np.random.default_rng(3).normal(size=300).round(2)),
    6: list(np.geomspace(1e-9, 1e9, 200) * np.resize([1, -1], 200)),
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(g, v if v is None else float(v)) for g, vs in GROUPS.items() for v in vs], "g int, v double")


def test_average_ranks_match_pandas(rows):
    got = {(r["g"], r["v"]): r["rank"] for r in ranks.average_ranks(rows, ["g"], "v", "rank").where("v IS NOT NULL").collect()}
    want = {}
    for g, vs in GROUPS.items():
        s = pd.Series(vs, dtype=float)
        want |= {(g, v): r for v, r in zip(s, s.rank(), strict=True) if not np.isnan(v)}
    assert got == want


def test_quantiles_match_numpy(rows):
    shares = (0.0, 0.1, 0.5, 0.8, 0.9, 1.0)
    got = {r["g"]: r["q"] for r in ranks.quantiles(rows, ["g"], "v", shares, "q").collect()}
    assert got.keys() == GROUPS.keys() and got[2] == [None] * len(shares)
    for g in (3, 4, 5, 6):
        np.testing.assert_allclose(got[g], np.quantile([v for v in GROUPS[g] if v is not None], shares), rtol=1e-12, atol=1e-15)
    assert got[1][0] == float("-inf") and got[1][-1] == float("inf")


def test_classes_keep_the_order_of_values(rows):
    values = [(r["v"], r["c"]) for r in rows.select("v", ranks.order_class(rows["v"]).alias("c")).where("v IS NOT NULL").collect()]
    values.sort()
    assert all(a[1] <= b[1] for a, b in zip(values, values[1:], strict=False)) and len({c for _, c in values}) > 300


def test_nothing(rows):
    assert ranks.quantiles(rows.limit(0), ["g"], "v", (0.5,), "q").count() == 0
    assert ranks.average_ranks(rows.limit(0), ["g"], "v", "rank").count() == 0
