"""Every registered query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beatloom.plans import cycle_queries as C
from beatloom.plans import ecg_queries as E
from beatloom.plans import series_queries as S

Query = Callable[[SparkSession, str], DataFrame]


def _public(module) -> dict[str, Query]:
    """Functions defined in a query module, in source order."""
    return {
        n: f for n, f in vars(module).items()
        if callable(f) and not n.startswith("_") and getattr(f, "__module__", "") == module.__name__
        and not getattr(f, "helper", False)
    }


QUERIES: dict[str, Query] = {**_public(S), **_public(C), **_public(E)}
