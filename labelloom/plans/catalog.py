"""All registered queries."""

from __future__ import annotations

from labelloom.plans import (  # noqa: F401
    answering, evaluation, modelling, neighbours, sampling, series, streams, tables, texts,
)
from labelloom.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, d):
    return QUERIES["knn_holdout_report"](spark, d)
