import numpy as np
import pytest

from veclens.operators import statistics


def test_signed_rank():
    assert statistics.signed_rank(np.zeros(5)) == (0.0, 1.0)
    assert statistics.signed_rank(np.array([1.0, 2.0, 3.0, 4.0, 5.0])) == (0.0, 0.0625)
    assert statistics.signed_rank(np.array([1.0, -2.0, 3.0, 0.0])) == (2.0, 0.75)
    low, p = statistics.signed_rank(np.array([1.0, 1.0, -1.0, 2.0, 2.0]))
    assert low == 2.0 and 0 < p < 1


def test_wilcoxon_by_group(spark):
    rows = [("x", float(i), 0.0) for i in range(1, 6)] + [("y", 1.0, 1.0)]
    got = {r.claim: (r.n, r.statistic, r.p_value) for r in statistics.wilcoxon(spark.createDataFrame(rows, "claim string, a double, b double"), ["claim"], "a", "b").collect()}
    assert got == {"x": (5, 0.0, 0.0625), "y": (1, 0.0, 1.0)}


def test_bootstrap(spark):
    rows = spark.createDataFrame([("g", i, float(i % 10)) for i in range(200)] + [("g", 999, None), ("h", 1, 3.0)], "g string, i long, x double")
    got = {r.g: r for r in statistics.mean_interval(rows, ["g"], "x", ["i"], 200).collect()}
    assert got["h"].mean == got["h"].ci_lo == 3.0
    assert got["g"].mean == pytest.approx(4.5, abs=0.1) and got["g"].ci_lo < 4.5 < got["g"].ci_hi
    assert statistics.mean_interval(rows.where("g = 'z'"), ["g"], "x", ["i"], 10).count() == 0
    again = {r.g: r for r in statistics.mean_interval(rows.repartition(3), ["g"], "x", ["i"], 200).collect()}
    assert again["g"].mean == pytest.approx(got["g"].mean)
