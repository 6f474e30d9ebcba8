"""Jobs of independent parts side by side.

Each part runs in a thread of its own that inherits the caller's job properties and has its own scheduler
pool. With ``spark.scheduler.mode=FAIR`` the pools share the cluster evenly; without it the parts still overlap
wherever one leaves cores idle.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

AT_ONCE = 10  # parts in flight; the others wait


def side_by_side(spark: SparkSession, parts: list[Callable], at_once: int = AT_ONCE, name: str = "part") -> list:
    """(result, error) of each part, in order; an error does not stop the other parts."""
    def in_pool(part: Callable, place: int) -> Callable:
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"cohortlens-{name}-{place}")
            return _outcome(part)

        return inheritable_thread_target(spark)(run)

    if len(parts) < 2:
        return [_outcome(p) for p in parts]
    with ThreadPoolExecutor(max_workers=min(at_once, len(parts))) as threads:
        # a pool per thread in flight, not per part, so that their number stays bounded
        running = [threads.submit(in_pool(p, i % at_once)) for i, p in enumerate(parts)]
        return [r.result() for r in running]


def _outcome(part: Callable) -> tuple:
    try:
        return part(), None
    except Exception as e:  # handed to the caller, who decides
        return None, e


def all_of(results: list) -> list:
    """The results, or the first error."""
    for _, error in results:
        if error is not None:
            raise error
    return [value for value, _ in results]
