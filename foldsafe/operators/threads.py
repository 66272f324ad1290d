"""Driver threads: several independent Spark jobs in flight, their tasks shared out by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

A = TypeVar("A")
B = TypeVar("B")


def in_threads(
    spark: SparkSession, work: Callable[[A], B], items: Iterable[A], threads: int
) -> list[B]:
    """Results of ``work`` in the items' order; the first error is raised."""
    todo = list(items)
    if not todo:
        return []
    with ThreadPool(max(1, min(threads, len(todo)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), todo)
