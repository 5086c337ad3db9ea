"""Columns over logits, probabilities and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions.scalar import _col


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column | str) -> Column:
    """Exponentials relative to the largest logit, divided by their sum."""
    logits = _col(logits)
    powers = _bind(
        F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top))
    )
    return _bind(
        powers,
        lambda ps: _bind(array_total(ps), lambda total: F.transform(ps, lambda p: p / total)),
    )


def argmax(values: Column | str) -> Column:
    """0-based index of the largest value, the first one on ties."""
    values = _col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def percent_weights(weights: Column | str) -> Column:
    """Absolute weights as shares of 100; all-zero weights become uniform."""
    size = F.transform(_col(weights), lambda w: F.abs(w).cast("double"))

    def shares(ws: Column) -> Column:
        return _bind(
            array_total(ws),
            lambda total: F.transform(
                ws,
                lambda w: F.when(total > 0, w / F.nullif(total, F.lit(0.0)) * 100).otherwise(
                    F.lit(100.0) / F.size(ws)
                ),
            ),
        )

    return _bind(size, shares)


def next_stage(prob: Column | str, stage: Column | str, threshold: float = 50, last: int = 4) -> Column:
    """The following stage once the threat probability passes the threshold."""
    prob, stage = _col(prob), _col(stage)
    moves = (prob > threshold) & (stage < last)
    return F.when(moves, stage + 1).otherwise(stage)


def status_band(confidence: Column | str, stage: Column | str, calm: int = 0) -> Column:
    confidence, stage = _col(confidence), _col(stage)
    return (
        F.when((confidence < 75) | (stage == calm), "MONITORING")
        .when(confidence < 90, "ELEVATED")
        .otherwise("CRITICAL")
    )


def ovr_vote(
    probs: Sequence[Column | str],
    names: Sequence[str],
    threshold: float = 0.5,
    default: str = "NORMAL",
) -> Column:
    """Name of the largest of several yes/no probabilities, or the default."""
    cols = [_col(p) for p in probs]
    best = F.greatest(*cols) if len(cols) > 1 else cols[0]
    vote = F.when(best < threshold, F.lit(default))
    for col, name in zip(cols, names):
        vote = vote.when(col == best, F.lit(name))
    return vote


def prediction_json(probs: Column | str, names: Sequence[str], **extra: Column) -> Column:
    """Prediction, its confidence and the whole distribution as JSON text."""
    probs = _col(probs)
    labels = F.array(*[F.lit(n) for n in names])
    as_text = F.transform(probs, lambda p: F.format_string("%.2f%%", p * 100))
    return F.to_json(
        F.struct(
            *[c.alias(n) for n, c in extra.items()],
            F.element_at(labels, argmax(probs) + 1).alias("prediction"),
            F.format_string("%.2f%%", F.array_max(probs) * 100).alias("confidence"),
            F.map_from_arrays(labels, as_text).alias("full_distribution"),
        )
    )
