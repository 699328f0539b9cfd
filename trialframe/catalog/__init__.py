"""The registered queries, by area."""

from . import auditing, curation, evaluation, experiments, files, modelling, selection, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
