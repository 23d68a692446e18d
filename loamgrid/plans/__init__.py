"""Query modules; importing them fills the registry."""

from loamgrid.plans import aggregates, files, gates, modelling, schema, spatial, streams, text, uncertainty  # noqa: F401
from loamgrid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
