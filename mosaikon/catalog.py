"""All queries of the engine by name, and the SQL they are checked against."""

from .plans import chemical, dataset, extras, graphs, masses, models, regional, spectral, stacks  # noqa: F401
from .plans.registry import ORACLE, QUERIES

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
FLAGSHIP = "region_contrast"
