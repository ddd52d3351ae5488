"""Exact quantiles by narrowing histograms against numpy."""

import numpy as np
import pytest

from paragauge.operators import quantiles


def table(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v), float(v) ** 9) for v in rng.random(400)]
    rows += [("b", float(v), float(10.0 ** rng.integers(-9, 9))) for v in rng.integers(0, 4, 301)]
    rows += [("c", 0.25, None), ("c", float("nan"), -1.5), (None, -7.0, 1e308), (None, 3.0, -1e308)]
    rows += [("d", v, 0.1 + 0.2) for v in (float("inf"), 1.0, 2.0, float("-inf"), 5.0)]
    return rows, spark.createDataFrame(rows, "model string, x double, y double")


@pytest.mark.parametrize("cells,told", [(1024, 100_000), (7, 1)])
def test_equals_numpy(spark, monkeypatch, cells, told):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    monkeypatch.setattr(quantiles, "TOLD_INTERVALS", told)
    rows, df = table(spark)
    if cells == 7:  # many rounds: only a few groups
        df, rows = df.where("model = 'a' OR model IS NULL"), [r for r in rows if r[0] in ("a", None)]
    got = {(r.model, r.variable): r for r in quantiles.describe_by(df.repartition(3), "model", ["x", "y"], (0.1, 0.5, 0.75)).collect()}
    want = {}
    for k, name in ((1, "x"), (2, "y")):
        for r in rows:
            if r[k] is not None and not np.isnan(r[k]):
                want.setdefault((r[0], name), []).append(r[k])
    assert got.keys() == want.keys()
    for key, values in want.items():
        row, values = got[key], np.array(values)
        assert row.n == len(values) and (row.min, row.max) == (values.min(), values.max())
        with np.errstate(all="ignore"):
            for q, found in ((0.1, row.q10), (0.5, row.q50), (0.75, row.q75)):
                at = np.sort(values)[[int(np.floor(q * (len(values) - 1))), int(np.ceil(q * (len(values) - 1)))]]
                part = q * (len(values) - 1) % 1
                exact = at[0] if at[0] == at[1] else at[0] + (at[1] - at[0]) * part
                assert found == exact or (np.isnan(found) and np.isnan(exact)) or abs(found - exact) < 1e-12 * abs(exact)


def test_nothing(spark):
    _, df = table(spark)
    assert quantiles.describe_by(df.where("false"), "model", ["x"]).collect() == []
    one = quantiles.describe_by(df.where("x = 0.25 AND model = 'c'"), "model", ["x", "y"]).collect()
    assert [(r.variable, r.n, r.q25, r.q75, r.std) for r in one] == [("x", 1, 0.25, 0.25, None)]
