"""Binary classification metrics (OP-42, 67-69) in one aggregation pass.

Precision and recall are those of class 1 (what a precision-recall curve over
hard 0/1 predictions reports at its middle point); a ratio with a zero
denominator is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y = F.col(label).cast("int")
    p = F.rint(F.col(prediction).cast("double")).cast("int")
    return df.agg(
        F.count_if((y == 1) & (p == 1)).cast("long").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("long").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("long").alias("fn"),
        F.count_if((y == 0) & (p == 0)).cast("long").alias("tn"),
    )


def classifier_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``tp, fp, fn, tn, accuracy, precision, recall, f1``."""
    c = confusion(df, label, prediction)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp",
        "fp",
        "fn",
        "tn",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
