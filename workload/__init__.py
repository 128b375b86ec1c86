"""The package's operators as queries over the driver's tables, with SQL to check them."""

from workload import (  # noqa: F401 - they register their queries
    bookkeeping,
    bundles,
    extraction,
    learning,
    mining,
    preparation,
    quality,
)
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
