"""End-to-end E2 (panel models) and E3 (growth curves) on sf0.001."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlens.plans import growth_curves, model_queries, panel_models
from regionlens.sources import standins

SF = "/root/testdata/sf0.001"


def test_panel_models_end_to_end(spark):
    panel = panel_models.build_panel(spark, SF)
    assert panel.features == ["ACCTBAL_2018", "QTY_2018", "PRICE_2018", "DISC_2018"]
    n = panel.frame.count()
    assert n > 0
    rep = panel_models.pcr_report(spark, panel)
    ratios = [r.ratio for r in rep["variance"].collect()]
    assert sum(ratios) == pytest.approx(1.0)
    r2 = [r.r2 for r in rep["r2_curve"].orderBy("components").collect()]
    assert all(b >= a - 1e-9 for a, b in zip(r2, r2[1:]))
    sw = panel_models.stepwise_report(spark, panel, "Cases")
    rss = [r.rss for r in sw["path"].orderBy("size").collect()]
    assert all(b <= a + 1e-9 for a, b in zip(rss, rss[1:]))
    assert sw["residuals"].count() == n
    assert all(math.isfinite(r.p_value) for r in sw["summary"].collect())


def test_growth_curves_end_to_end(spark):
    long = standins.event_series(spark, SF).select("user_id", "t", F.col("cases").alias("value"))
    fits = growth_curves.fit_all(long, "user_id")
    n_users = long.select("user_id").distinct().count()
    rows = fits.collect()
    assert len(rows) == n_users
    ok = [r for r in rows if r.status == "ok"]
    assert ok and all(r.a > 0 and r.tau > 0 and r.growth_rate == pytest.approx(1 / r.tau) for r in ok)
    report = growth_curves.top_series_report(long, fits, "user_id", 8).collect()
    assert len(report) == 8
    latest = [r.latest for r in report]
    assert latest == sorted(latest, reverse=True)


def test_panel_classifier_report(spark):
    panel = panel_models.build_panel(spark, SF)
    median = panel.frame.approxQuantile("Fatality", [0.5], 0.0)[0]
    rep = panel_models.classifier_report(panel, "Fatality", median, max_iter=5, max_depth=3)
    m = rep["metrics"].collect()[0]
    assert m.tp + m.fp + m.fn + m.tn == rep["predictions"].count()
    assert {r["feature"] for r in rep["importance"]} == set(panel.features)


def test_panel_queries_equal_plain_fits(spark):
    base = "/root/testdata/sf0.01"
    panel = panel_models.build_panel(spark, base)
    rows = panel.frame.orderBy("FIPS").collect()
    x = np.array([[r[c] for c in panel.features] for r in rows], dtype=float)
    scaled = (x - x.min(0)) / (x.max(0) - x.min(0))
    fips = [r["FIPS"] for r in rows]
    steps = model_queries.q_panel_selection(spark, base).collect()
    residuals = model_queries.q_panel_residuals(spark, base).collect()
    for response in ("Cases", "Deaths"):
        y = np.log10(1 + np.array([r[response] for r in rows], dtype=float))
        path = sorted((r for r in steps if r["response"] == response), key=lambda r: r["size"])
        assert sum(r["chosen"] for r in path) == 1
        used = []
        for r in path:
            left = [j for j in range(x.shape[1]) if j not in used]
            rss = {j: float(np.square(y - scaled[:, [*used, j]] @ np.linalg.lstsq(scaled[:, [*used, j]], y, rcond=None)[0]).sum()) for j in left}
            used.append(min(left, key=rss.get))
            assert r["added"] == panel.features[used[-1]] and r["rss"] == pytest.approx(rss[used[-1]], abs=1e-4)
            if r["chosen"]:
                model = scaled[:, used]
                want = dict(zip(fips, y - model @ np.linalg.lstsq(model, y, rcond=None)[0], strict=True))
        got = {r["FIPS"]: r["residual"] for r in residuals if r["response"] == response}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)

    train = np.array([int(hashlib.md5(f"0:{f}".encode()).hexdigest()[:8], 16) >= int(0.2 * 2**32) for f in fips])
    cases = np.array([r["Cases"] for r in rows], dtype=float)
    z = np.column_stack([np.ones(len(x)), (x - x[train].mean(0)) / x[train].std(0, ddof=1)])
    fit = train & (cases > 0)
    beta = np.linalg.lstsq(z[fit], np.log10(cases[fit]), rcond=None)[0]
    want = {f: float(v) for f, v, test in zip(fips, z @ beta, ~train & (cases > 0), strict=True) if test}
    got = {r["FIPS"]: r["predicted"] for r in model_queries.q_panel_pcr_holdout(spark, base).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_panel_components_equal_plain_ones(spark):
    base = "/root/testdata/sf0.01"
    panel = panel_models.build_panel(spark, base)
    rows = panel.frame.orderBy("FIPS").collect()
    x = np.array([[r[c] for c in panel.features] for r in rows], dtype=float)
    cases = np.array([r["Cases"] for r in rows], dtype=float)
    train = np.array([int(hashlib.md5(f"0:{r['FIPS']}".encode()).hexdigest()[:8], 16) >= int(0.2 * 2**32) for r in rows])
    z = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
    _, size, axes = np.linalg.svd(z[train], full_matrices=False)
    value = size**2 / (train.sum() - 1)
    axes = axes * np.array([1 if a[np.abs(a).argmax()] > 0 else -1 for a in axes])[:, None]
    for r in model_queries.q_panel_pca(spark, base).collect():
        j = r["component"] - 1
        assert r["eigenvalue"] == pytest.approx(value[j], abs=1e-5) and r["cumulative"] == pytest.approx(value[: j + 1].sum() / value.sum(), abs=1e-5)
        assert r["loading"] == pytest.approx(axes[j, panel.features.index(r["feature"])] * math.sqrt(value[j]), abs=1e-5)

    fit, score = train & (cases > 0), np.column_stack([np.ones(len(z)), z @ axes.T])
    y = np.log10(cases[fit])
    for r in model_queries.q_panel_pcr_curve(spark, base).collect():
        a = score[fit][:, : r["components"] + 1]
        rss = np.square(y - a @ np.linalg.lstsq(a, y, rcond=None)[0]).sum()
        assert r["rank"] == r["components"] + 1 and r["r2"] == pytest.approx(1 - rss / np.square(y - y.mean()).sum(), abs=1e-5)
    beta = np.linalg.lstsq(score[fit][:, :3], y, rcond=None)[0]
    want = {r["FIPS"]: float(v) for r, v, t in zip(rows, score[:, :3] @ beta, ~train & (cases > 0), strict=True) if t}
    got = {r["FIPS"]: r["predicted"] for r in model_queries.q_panel_pcr_holdout_2(spark, base).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
