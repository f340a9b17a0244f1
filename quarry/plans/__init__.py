"""All queries of the library, by area."""

from quarry.plans import catalogue, content, details, folders, operations, searching, similarity, sources  # noqa: F401
from quarry.plans.registry import ORACLES, QUERIES  # noqa: F401
