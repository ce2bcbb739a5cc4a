"""Registered queries; importing the package fills the registry."""

from . import experiment_queries, project_queries, regression_queries, screening_queries, split_queries, surrogate_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
