"""How the driver's tables stand for geometry, and the registered queries."""

from geoweft.plans import catalog, catalog_more

__all__ = ["catalog", "catalog_more"]
