"""Scalar Column functions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import STABILITY_CONST


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Lower-case word tokens: runs of a-z, empty pieces dropped.

    The whole text is split; nothing is truncated. A NULL text has no tokens.
    """
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z]+"), lambda t: t != F.lit(""))


def whitespace_tokens(text) -> Column:
    """Whitespace-separated pieces of the text, empty pieces dropped (none for NULL)."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), "\\s+"), lambda t: t != F.lit(""))


def sigmoid(logit) -> Column:
    """1 / (1 + exp(-x)). exp overflows to +inf for x < -709, giving 0.0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(logit)))


def log_loss(label, prob, c: float = STABILITY_CONST) -> Column:
    """Clipped per-row log loss -y ln(p + c) - (1 - y) ln(1 - p + c).

    The constant keeps ln finite, so the loss never exceeds -ln(c) ~ 34.54.
    """
    y = _c(label).cast("double")
    p = _c(prob).cast("double")
    return -y * F.log(p + F.lit(c)) - (F.lit(1.0) - y) * F.log(F.lit(1.0) - p + F.lit(c))


def positive_logit(class_logits) -> Column:
    """Logit of the positive class: element 2 of the per-class logit array."""
    return F.element_at(_c(class_logits), 2)


def round6(x) -> Column:
    return F.round(_c(x), 6)
