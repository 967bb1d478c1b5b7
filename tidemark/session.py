"""Sessions, and the folder every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")

_LOCAL_SHARED: dict[str, str] = {}


def build_session(cpus: int | str = 8, app: str = "tidemark", memory: str = "8g",
                  **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session is given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, whose tasks all run on this machine, may fall back to a temporary
    folder; on a cluster a missing setting is an error, since executors could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(_LOCAL_SHARED[app])
    return _LOCAL_SHARED[app]


def scratch_name(name: str) -> str:
    """A name that no earlier run has used."""
    return f"{name}-{uuid.uuid4().hex[:12]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{scratch_name(name)}"


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], T]], at_most: int = 8) -> list[T]:
    """Run independent jobs side by side, so that one table's last tasks do not idle the rest.

    Each job is an action on the executors; the threads only wait. The first error is raised.
    """
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(at_most, len(jobs))) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))
