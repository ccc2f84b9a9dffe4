"""Named queries over the driver tables with their SQL counterparts."""

from facetry.catalog import extra, files, metrics, models, search, space, surface  # noqa: F401  (each module registers its queries)
from facetry.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
