"""Time budgets and pools for the jobs of a stage.

Jobs started within carry a tag, and are cancelled by it once the time is over, in whatever thread or executor they run; the stage then ends with
TimeOver and gives no part of its result. With a pool, jobs share the cluster by fair scheduling where the session has it on (spark.scheduler.mode
FAIR), so a watch gives way to queries.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class TimeOver(TimeoutError):
    """The jobs of a stage were cancelled, as its time was over."""


@contextmanager
def limited(spark: SparkSession, seconds: float, name: str = "stage") -> Iterator[None]:
    """Raises TimeOver where the jobs started within take longer; 0 or less: no limit. Jobs that start after the end are cancelled as well."""
    if seconds <= 0:
        yield
        return
    sc, tag, done, over = spark.sparkContext, f"{name}-{uuid.uuid4().hex[:8]}", threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        over.set()
        while not done.wait(0.2):
            sc.cancelJobsWithTag(tag)

    sc.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise TimeOver(f"{name} took more than {seconds:g} s") from e
        raise
    finally:
        done.set()
        sc.removeJobTag(tag)
    if over.is_set():
        raise TimeOver(f"{name} took more than {seconds:g} s")


@contextmanager
def pool(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs of this thread go to a fair-scheduling pool."""
    sc, key = spark.sparkContext, "spark.scheduler.pool"
    before = sc.getLocalProperty(key)
    sc.setLocalProperty(key, name)
    try:
        yield
    finally:
        sc.setLocalProperty(key, before)
