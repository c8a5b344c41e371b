"""E2: regional panel -> feature matrix -> PCR, boosted trees, stepwise OLS.

The panel (rates joined to the attribute tables) feeds several model passes,
so it is materialised once with a reliable checkpoint under the session's
shared checkpoint folder: later passes read the written table instead of
re-running the joins, and a lost executor does not force a recompute from the
raw files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.functions.scalar import log10_1p, log10_positive, threshold_label
from regionlens.operators import boost, features, metrics, missing, pcr, stepwise
from regionlens.plans.registry import supplier_panel
from regionlens.session import cut_lineage

RATE_COLUMNS = ("FIPS", "County", "Cases", "Population", "Deaths", "InfectionRate", "Fatality")
# Label thresholds of the two classifiers.
FATALITY_THRESHOLD = 0.01
INFECTION_THRESHOLD = 0.01


@dataclass
class Panel:
    frame: DataFrame
    features: list[str]


def build_panel(spark: SparkSession, base: str) -> Panel:
    """Panel with complete rows only; features are every column after the rates."""
    raw = supplier_panel(spark, base)
    feats = [c for c in raw.columns if c not in RATE_COLUMNS]
    clean = missing.drop_missing(raw, feats)
    return Panel(cut_lineage(clean), feats)


def pcr_report(spark: SparkSession, panel: Panel, n_pc: int | None = None) -> dict[str, DataFrame]:
    """PCA on the standardised training features; R^2 of log10(cases) on the
    first i components; holdout predictions with ``n_pc`` components."""
    split = features.hash_split(panel.frame, "FIPS", 0.2, 0)
    train = split.filter(F.col("split") == "train")
    z_all = features.standardize(split, panel.features, keep=("FIPS", "Cases", "split"), fit_on=train)
    z_train = z_all.filter(F.col("split") == "train")
    fit = pcr.fit_pca(z_train, panel.features)
    k = len(panel.features)
    y_train = z_train.filter(F.col("Cases") > 0).withColumn("y", log10_positive("Cases"))
    curve = pcr.r2_curve(pcr.scores(y_train, fit, keep=("y",)), "y", k)
    n_pc = min(n_pc or k, k)
    names = [f"pc{j + 1}" for j in range(n_pc)]
    beta, b0 = pcr.fit_linear(pcr.scores(y_train, fit, keep=("y",), k=n_pc), names, "y")
    test = z_all.filter((F.col("split") == "test") & (F.col("Cases") > 0)).withColumn("y", log10_positive("Cases"))
    pred = F.lit(b0)
    for c, b in zip(names, beta):
        pred = pred + F.lit(float(b)) * F.col(c)
    holdout = pcr.scores(test, fit, keep=("FIPS", "y"), k=n_pc).select("FIPS", F.col("y").alias("actual"), pred.alias("predicted"))
    return {
        "variance": pcr.variance_frame(spark, fit),
        "loadings": pcr.loadings_frame(spark, fit),
        "r2_curve": spark.createDataFrame(curve, pcr.R2_SCHEMA),
        "holdout": holdout,
    }


def classifier_reports(panel: Panel, models: dict[str, tuple[float, dict]]) -> dict[str, dict]:
    """Boosted trees for ``rate >= threshold`` of each of ``models`` (rate: threshold and
    parameters) with a 0.33 hash holdout; the models are grown together."""
    label = {rate: f"label_{k}" for k, rate in enumerate(models)}
    df = panel.frame.withColumns({label[r]: threshold_label(r, t).cast("double") for r, (t, _) in models.items()})
    df = features.hash_split(df, "FIPS", 0.33, 7)
    train, test = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")
    fitted = boost.fit_each(train, panel.features, "FIPS", {label[r]: params for r, (_, params) in models.items()})
    out = {}
    for rate in models:
        model = fitted[label[rate]]
        pred = boost.predict(model, test, panel.features, keep=("FIPS", label[rate]))
        out[rate] = {
            "predictions": pred,
            "metrics": metrics.classifier_metrics(pred, label[rate]).withColumn("n_trees", F.lit(len(model.trees))),
            "importance": boost.importance(model, panel.features),
        }
    return out


def classifier_report(panel: Panel, rate: str, threshold: float, **params) -> dict:
    """One of ``classifier_reports``."""
    return classifier_reports(panel, {rate: (threshold, params)})[rate]


def stepwise_report(spark: SparkSession, panel: Panel, response: str = "Cases") -> dict:
    """Min-max scaled features, y = log10(1 + response): forward path, the
    BIC-chosen model's coefficient table and its residuals."""
    frame = panel.frame.select("FIPS", *panel.features, log10_1p(response).alias("y"))
    scaled, constant = features.minmax_scale(frame, panel.features, keep=("FIPS", "y"))
    used = [c for c in panel.features if c not in constant]
    gram = stepwise.regression_gram(scaled, used, "y")
    path = stepwise.forward_path(gram)
    chosen = stepwise.choose(path, "bic")
    summary = stepwise.ols_summary(gram, chosen["predictors"])
    coefs = {r["predictor"]: r["coef"] for r in summary}
    fitted = stepwise.fitted_column(coefs)
    residuals = scaled.select("FIPS", "y", fitted.alias("fitted")).withColumn("residual", F.col("y") - F.col("fitted"))
    return {
        "path": stepwise.forward_path_frame(spark, path),
        "chosen": chosen,
        "summary": spark.createDataFrame(summary, "predictor string, coef double, std_err double, t double, p_value double"),
        "residuals": residuals,
        "constant_columns": constant,
    }
