"""Which engine scores alignments: a choice by hardware alone, so it can be recorded and tested without any."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Machine:
    cuda: bool
    metal: bool
    cores: int
    free_gb: float


def probe(spark: SparkSession, path: str = ".") -> Machine:
    """What the session offers: GPUs that its resources name, executor cores in all, and the driver's free disk."""
    gpu = any("gpu" in k for k in spark.sparkContext.resources)
    return Machine(gpu, False, spark.sparkContext.defaultParallelism or os.cpu_count() or 1, shutil.disk_usage(path).free / 1e9)


def choose(machine: Machine, force: str = "auto") -> str:
    """cuda before metal before cpu, unless one is forced."""
    if force != "auto":
        return force
    return "cuda" if machine.cuda else "metal" if machine.metal else "cpu"
