import math

import pytest

from quantalume.functions.columns import adjust_p, bin_label, poibin_cdf
from quantalume.functions.distributions import evaluate
from quantalume.operators import describe, hypothesis, ranks, regression

SLEEP = [(0.7, 1.9), (-1.6, 0.8), (-0.2, 1.1), (-1.2, 0.1), (-0.1, -0.1), (3.4, 4.4), (3.7, 5.5), (0.8, 1.6), (0.0, 4.6), (2.0, 3.4), (None, 1.0)]


def one(df):
    return df.first()["result"]


def test_distributions():
    assert evaluate("pnorm", 1.96) == pytest.approx(0.9750021048517795, abs=1e-12)
    assert evaluate("qnorm", 0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert evaluate("qt", 0.975, 10) == pytest.approx(2.228138851986273, abs=1e-9)
    assert evaluate("pchisq", 5, 3) == pytest.approx(0.8282028557032666, abs=1e-12)
    assert evaluate("qf", 0.95, 2, 10) == pytest.approx(4.102821015130402, abs=1e-9)
    assert evaluate("dnbinom", 0, 2, 1.0) == 1.0
    assert math.isnan(evaluate("dnorm", 0, 0, -1))
    for k in range(8):
        assert evaluate("qpois", evaluate("ppois", k, 2.5), 2.5) == k


def test_corrections_and_bins():
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    assert adjust_p(p, "holm")[:3] == pytest.approx([0.008, 0.056, 0.234])
    assert adjust_p(p, "BH") == pytest.approx([0.008, 0.032, 0.0672, 0.0672, 0.0672, 0.08, 0.0845714, 0.205], abs=1e-6)
    assert adjust_p([0.01, None, 0.02], "bonferroni") == [0.02, None, 0.04]
    with pytest.raises(ValueError, match="unknown method"):
        adjust_p(p, "bh")
    assert poibin_cdf([0.5, 0.5], 1) == pytest.approx(0.75) and poibin_cdf([], 0) == 1.0 and poibin_cdf([2.0], 0) is None
    assert bin_label(2.0, [0.0, 1.0, 2.0]) == "[1, 2]" and bin_label(3.0, [0.0, 1.0]) is None


def test_paired_and_sign_tests(spark):
    df = spark.createDataFrame(SLEEP, "a double, b double")
    assert one(hypothesis.ttest_paired(df, "a", "b"))["t_statistic"] == pytest.approx(-4.0621, abs=1e-4)
    w = one(ranks.wilcoxon_signed_rank(df, "a", "b"))
    assert (w["w_statistic"], round(w["z_statistic"], 4), round(w["p_value"], 4)) == (0.0, -2.6679, 0.0076)
    s = one(hypothesis.sign_test_paired(df, "a", "b"))
    assert (s["m_statistic"], s["n_zero"], round(s["p_value"], 4)) == (-4.5, 1, 0.0039)


def test_two_samples(spark):
    df = spark.createDataFrame([(float(i), float(i + 2)) for i in range(1, 6)], "a double, b double")
    r = one(hypothesis.ttest_2samp(df, "a", "b"))
    assert (r["t_statistic"], r["df"]) == (-2.0, 8.0) and r["p_value"] == pytest.approx(0.0805, abs=1e-4) and r["ci_lower"] == pytest.approx(-4.306, abs=1e-3)
    m = one(ranks.mann_whitney_u(df, "a", "b"))
    assert (m["u_statistic"], round(m["rank_biserial"], 2)) == (4.5, 0.64)
    with pytest.raises(ValueError, match="alternative must be"):
        hypothesis.ttest_2samp(df, "a", "b", alternative="up")
    assert one(hypothesis.ttest_1samp(df.limit(1), "a")) is None


def test_tables_and_normality(spark):
    rows = [("x", "p")] * 8 + [("x", "q")] * 2 + [("y", "p")] * 2 + [("y", "q")] * 8
    c = spark.createDataFrame(rows, "r string, c string")
    assert one(hypothesis.chisq_independence(c, "r", "c"))["chi_square"] == pytest.approx(7.2)
    assert one(hypothesis.chisq_independence(c, "r", "c", True))["chi_square"] == pytest.approx(5.0)
    t = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    assert one(ranks.shapiro_wilk(t, "x"))["w_statistic"] == pytest.approx(0.97016, abs=1e-5)
    a = one(ranks.anderson_darling(t, "x"))
    assert (round(a["a_squared"], 4), round(a["p_value"], 4)) == (0.1411, 0.9567)
    s = one(describe.summary_stats(t, "x"))
    assert (s["n"], s["q1"], s["median"], s["q3"]) == (10, 3.25, 5.5, 7.75) and round(s["sd"], 4) == 3.0277


def test_regression(spark):
    cars = [(1.0, 2.0), (2.0, 2.9), (3.0, 4.2), (4.0, 5.1), (5.0, None)]
    df = spark.createDataFrame(cars, "x double, y double")
    terms = {r["term"]: r["estimate"] for r in regression.lm(df, formula="y ~ x").collect()}
    assert terms["x"] == pytest.approx(1.06) and terms["(Intercept)"] == pytest.approx(0.9)
    assert regression.lm_summary(df, "y", ["x"]).first()["n"] == 4
    for bad in ("y ~", "y x", "y ~ x + x", "y ~ x + 2"):
        with pytest.raises(ValueError, match="formula"):
            regression.lm(df, formula=bad)
    with pytest.raises(ValueError, match="requires a cluster"):
        regression.lm_fit(df, "y", ["x"], "CR1")
    assert one(regression.lm_fit(df, "y", ["x"], "HC1"))["n"] == 4


def test_kendall_counts_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    for levels in (1, 2, 6, 40):
        x, y, w = rng.integers(0, levels, 60), rng.integers(0, 6, 60), rng.integers(1, 4, 60)
        s = sum(int(w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])) for i in range(60) for j in range(i))
        assert ranks.concordance(x.astype(float), y.astype(float), w) == s


def test_kendall_in_blocks(spark, monkeypatch):
    """Many small blocks, a hot x, null groups, nulls and an empty group give what one block gives."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(g, float(rng.integers(0, 20)), float(rng.integers(0, 30))) for g in ("a", None) for _ in range(150)]
    rows += [("a", 7.0, float(i)) for i in range(60)] + [("a", None, 1.0), ("a", math.nan, 1.0), ("b", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    whole = {r["g"]: r["result"] for r in ranks.kendall_test(df, "x", "y", by=["g"]).collect()}
    assert set(whole) == {"a", "b", None} and whole["b"] is None
    for g in ("a", None):
        x, y = (np.array([r[k] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]]) for k in (1, 2))
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        tau = (sx * sy).sum() / math.sqrt((sx * sx).sum() * (sy * sy).sum())
        assert whole[g]["tau"] == pytest.approx(tau, abs=1e-12) and whole[g]["n"] == len(x)
    monkeypatch.setattr(ranks, "RANGE_ROWS", 25)
    monkeypatch.setattr(ranks, "SMALL_ROWS", 10)
    assert {r["g"]: r["result"] for r in ranks.kendall_test(df, "x", "y", by=["g"]).collect()} == whole


def test_rank_correlation_matrix(spark):
    df = spark.createDataFrame([(float(i), float(i % 4), float(-i), None) for i in range(12)], "a double, b double, c double, d double")
    for method, test, field in (("spearman", ranks.spearman_test, "rho"), ("kendall", ranks.kendall_test, "tau")):
        got = describe.corr_matrix(df, list("abcd"), method).collect()
        assert [(r["row_var"], r["col_var"]) for r in got] == [(x, y) for x in "abcd" for y in "abcd"]
        cell = {(r["row_var"], r["col_var"]): r for r in got}
        want = one(test(df, "a", "b"))
        assert cell["b", "a"]["coef"] == cell["a", "b"]["coef"] == pytest.approx(want[field]) and cell["a", "b"]["n"] == 12
        assert cell["a", "c"]["coef"] == pytest.approx(-1.0) and cell["a", "d"]["coef"] is None and cell["a", "a"]["coef"] == pytest.approx(1.0)
        assert [r["coef"] for r in describe.corr_matrix(df.limit(0), ["a", "b"], method).collect()] == [None] * 4


def test_null_is_a_group_of_its_own(spark):
    rng = __import__("random").Random(2)
    rows = [(g, rng.gauss(0, 1), rng.gauss(0, 1), rng.choice("pqr"), rng.choice("st")) for g in ("a", None) for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, x double, y double, r string, c string")
    a = df.where("g = 'a'")
    for test, args in [
        (hypothesis.anova_oneway, ("x", "r")), (hypothesis.chisq_independence, ("r", "c")), (ranks.shapiro_wilk, ("x",)), (ranks.ks_test_1samp, ("x",)),
        (ranks.ks_test_2samp, ("x", "y")), (ranks.anderson_darling, ("x",)), (ranks.mann_whitney_u, ("x", "y")), (ranks.spearman_test, ("x", "y")),
        (ranks.kendall_test, ("x", "y")), (regression.lm_fit, ("y", ["x"], "HC1")), (ranks.wilcoxon_signed_rank, ("x", "y")),
    ]:
        got = {r["g"]: r["result"] for r in test(df, *args, by=["g"]).collect()}
        alone = [test(d, *args).first()["result"] for d in (a, df.where("g is null"))]
        for g, want in zip(("a", None), alone):
            assert got[g] is not None, test.__name__
            flat = lambda r: [v for v in r if not isinstance(v, list)]
            assert [pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in flat(want)] == flat(got[g]), test.__name__


def test_bootstrap(spark, monkeypatch):
    """Moments of replicates against theory, NULL for groups without values, the same for any partitions, in many ranges too."""
    import numpy as np

    rows = [("a", float(i)) for i in range(100)] + [(None, 3.0)] + [("b", None), ("c", 1.0), ("c", math.inf)]
    df = spark.createDataFrame(rows, "g string, x double")
    exact = {"mean": 49.5, "median": 49.5, "sum": 4950.0, "sd": 28.87, "var": 833.25, "min": 0.0, "max": 99.0}
    for ranges in (250_000, 7):
        monkeypatch.setattr(ranks, "RANGE_ROWS", ranges)
        got = {r["g"]: r["replicates"] for r in describe.bootstrap(df, "x", "mean", 400, seed=1, by=["g"]).collect()}
        assert got["b"] is None and got[None] == [3.0] * 400 and len(got["a"]) == 400 and set(got["c"]) == {1.0, math.inf}
        assert np.mean(got["a"]) == pytest.approx(49.5, abs=0.6) and np.std(got["a"]) == pytest.approx(2.887, rel=0.15)
        again = describe.bootstrap(df.repartition(3), "x", "MEAN", 400, seed=1, by=["g"]).where("g = 'a'").first()["replicates"]
        assert again == got["a"]
    for name, want in exact.items():
        v = describe.bootstrap(df.where("g = 'a'"), "x", name, 100, seed=2).first()["replicates"]
        assert len(v) == 100 and np.mean(v) == pytest.approx(want, rel=0.1, abs=3)
        if name == "median":
            assert all((2 * m).is_integer() for m in v) and 3 < np.std(v) < 7
    assert describe.bootstrap(df.where("g is null"), "x", "sd", 2, seed=2).first()["replicates"][0] != 0.0  # one value has no spread
    assert describe.bootstrap(df.where("g = 'z'"), "x", "sd", 2).count() == 0


def test_poibin_query_has_a_row_for_every_order(spark):
    from quantalume.plans.queries import QUERIES

    path = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{path}/lineitem.parquet").select("l_orderkey").distinct()
    got = QUERIES["poibin_cdf"](spark, path)
    assert got.count() == orders.count() and got.where("cdf is null or cdf < 0 or cdf > 1").count() == 0


def test_anderson_darling_far_from_normal(spark):
    # A^2 grows with the rows; the exponent of its p-value is above what exp can hold here
    a = one(ranks.anderson_darling(spark.range(10_000).selectExpr("id % 2 as x"), "x"))
    assert a["a_squared"] > 560 and (a["p_value"], a["n"]) == (1.0, 10_000)
    assert ranks.anderson_p(5.0) == pytest.approx(math.exp(1.2937 - 5.709 * 5 + 0.0186 * 25))
    assert ranks.anderson_p(150.0) < 1e-100


def test_shapiro_query_has_the_sizes_of_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from quantalume.plans.queries import ORACLES, shapiro_wilk

    sizes = spark.createDataFrame([("few", 11), ("least", 12), ("most", 5000), ("over", 5001)], "c_mktsegment string, n int")
    rows = sizes.selectExpr("c_mktsegment", "explode(sequence(1, n)) as i").selectExpr("c_mktsegment", "sqrt(i) as c_acctbal")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    found = shapiro_wilk(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        result = db.execute(ORACLES["shapiro_wilk"])
        names = [c[0] for c in result.description]
        expected = sorted(result.fetchall())
    assert sorted(tuple(r) for r in found.select(*names).collect()) == expected and [r[0] for r in expected] == ["least", "most"]
    # the operator keeps every group: a test of 11 values, NULL beyond 5000
    kept = {r["c_mktsegment"]: r["result"] for r in ranks.shapiro_wilk(rows, "c_acctbal", by=["c_mktsegment"]).collect()}
    assert len(kept) == 4 and kept["few"]["n"] == 11 and kept["over"] is None
