"""One registered query per operator."""

from . import (  # noqa: F401
    evaluation, features, files, modelling, preparation, plotting, splits, statistics, streams, versions,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
