"""Losses of predictions held against encoded targets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.annotation import SType

Z_WEIGHT, TIME_WEIGHT, DELTA = 1e-4, 2.0, 1.0


def bce(logit: Column, label: Column) -> Column:
    """Binary cross-entropy from a logit, stable for large ones."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def huber(error: Column, delta: float = DELTA) -> Column:
    small = F.least(F.abs(error), F.lit(delta))
    return F.lit(0.5) * small * small + F.lit(delta) * (F.abs(error) - small)


def time_loss(pred: Column, truth: Column, weight: float = TIME_WEIGHT) -> Column:
    """Mean Huber loss of the 14 cyclic slots and the weighted one of the last."""
    each = F.zip_with(pred, truth, lambda p, t: huber(p.cast("double") - t.cast("double")))
    return F.aggregate(F.slice(each, 1, 14), F.lit(0.0), lambda a, x: a + x) / 14 + F.lit(weight) * F.element_at(each, 15)


def category_loss(logits: Column, choice: Column, weight: float = Z_WEIGHT) -> Column:
    """Cross-entropy of the category at choice (from 0) among a column's own logits, and the z-loss."""
    top = F.array_max(logits)
    log_z = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    own = F.element_at(logits, F.least(F.greatest(choice, F.lit(0)), F.size(logits) - 1).cast("int") + 1)
    return log_z - own + F.lit(weight) * log_z * log_z


def cell_loss(df: DataFrame) -> Column:
    """Null loss and, for cells that are not null, the loss of the target's type.

    df has target_stype, is_null (0 or 1), null_logit, and num_pred, num_true, bool_logit, bool_true, ts_pred, ts_true,
    cat_logits, cat_true as far as its types need them.
    """
    kinds = {
        SType.NUMERICAL: ("num_pred", lambda: huber(F.col("num_pred") - F.col("num_true"))),
        SType.BOOLEAN: ("bool_logit", lambda: bce(F.col("bool_logit"), F.col("bool_true"))),
        SType.TIMESTAMP: ("ts_pred", lambda: time_loss(F.col("ts_pred"), F.col("ts_true"))),
        SType.CATEGORICAL: ("cat_logits", lambda: category_loss(F.col("cat_logits"), F.col("cat_true"))),
    }
    own = F.lit(0.0)
    for kind, (column, loss) in kinds.items():
        if column in df.columns:
            own = F.when(F.col("target_stype") == int(kind), loss()).otherwise(own)
    null = F.col("is_null").cast("double")
    return bce(F.col("null_logit"), null) + F.when(F.col("is_null") == 1, F.lit(0.0)).otherwise(own)


def masked_mean(loss: Column, is_target: Column) -> Column:
    """An aggregate: the mean of loss over targets, 0 without any."""
    t = is_target.cast("double")
    return F.sum(loss * t) / F.greatest(F.sum(t), F.lit(1.0))


def decoded_number(z: Column, mean: float, std: float) -> Column:
    return z * F.lit(std) + F.lit(mean)


def decoded_boolean(logit: Column) -> Column:
    return logit > 0


def decoded_category(logits: Column) -> Column:
    """Place of the greatest logit from 0, the first of equal ones."""
    return F.array_position(logits, F.array_max(logits)) - 1


def schedule(step: Column, warmup: int, total: int, peak: float, floor: float = 0.1) -> Column:
    """Learning rate: linear to its peak, then a cosine down to a share of it."""
    rise = step / F.lit(float(max(warmup, 1)))
    done = F.least((step - F.lit(warmup)) / F.lit(float(max(total - warmup, 1))), F.lit(1.0))
    fall = F.lit(floor) + F.lit(1 - floor) * F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * done))
    return F.lit(peak) * F.when(step < warmup, rise).otherwise(fall)
