"""All registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries
from . import discovery_queries as _discovery  # noqa: F401  registers its queries
from . import evidence_queries as _evidence  # noqa: F401  registers its queries
from . import inspect_queries as _inspect  # noqa: F401  registers its queries
from . import inventory_queries as _inventory  # noqa: F401  registers its queries
from . import license_queries as _license  # noqa: F401  registers its queries
from . import lifecycle_queries as _lifecycle  # noqa: F401  registers its queries
from . import more_queries as _more  # noqa: F401  registers its queries
from . import process_queries as _process  # noqa: F401  registers its queries
from . import search_queries as _search  # noqa: F401  registers its queries
from . import supply_queries as _supply  # noqa: F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return graph_queries.queries()


def oracle_sql() -> dict[str, str]:
    return graph_queries.oracle_sql()
