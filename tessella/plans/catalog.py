"""All registered queries of the segmentation operators."""

from __future__ import annotations

from tessella.plans import evaluation, graphs, imaging, pipelines, sequences, storing
from tessella.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "evaluation", "graphs", "imaging", "pipelines", "sequences", "storing"]
