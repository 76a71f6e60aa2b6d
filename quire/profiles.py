"""Resources of single stages."""

from __future__ import annotations

import re

from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession

_made: dict[tuple[str, int], ResourceProfile] = {}


def one_task_an_executor(spark: SparkSession) -> ResourceProfile | None:
    """A profile whose tasks take all cores of an executor, so that each has its memory alone; None where Spark has no such thing, on one machine,
    or where the cores aren't told. A session has one, as a stage takes no two."""
    context = spark.sparkContext
    small = re.match(r"local-cluster\[\s*\d+\s*,\s*(\d+)", context.master)
    if not small and context.master.startswith("local"):
        return None
    cores = int(small[1] if small else context.getConf().get("spark.executor.cores", "1"))
    if cores <= int(context.getConf().get("spark.task.cpus", "1")):
        return None
    key = context.applicationId, cores
    if key not in _made:
        _made[key] = ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build
    return _made[key]
