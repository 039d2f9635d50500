"""Named stages with stored outputs: skipped when done, forced on request, recorded in a manifest."""

from __future__ import annotations

import json
import platform
import subprocess
import sys
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, is_dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output lies at path, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def set_aside(spark: SparkSession, path: str, tag: str) -> str | None:
    """Moves an output to path.tag before a fresh run, with a number if that is taken; where it went, or None if there was none."""
    jvm = spark.sparkContext._jvm
    here = jvm.org.apache.hadoop.fs.Path(path)
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(here):
        return None
    n, to = 0, f"{path}.{tag}"
    while store.exists(jvm.org.apache.hadoop.fs.Path(to)):
        n, to = n + 1, f"{path}.{tag}.{n + 1}"
    if not store.rename(here, jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not be moved to {to}")
    return to


def refuse_inexact(gene_data: str | None, allow: bool = False) -> None:
    """Stops a build from a selection whose gene sets were estimated, unless that is allowed."""
    if gene_data == "estimated" and not allow:
        raise ValueError("the selection was made with estimated gene sets: select again with exact ones, or allow it")


def code_state(folder: str) -> dict[str, object]:
    """Commit, branch, and changed files of a code folder, for a manifest; empty where there is no repository."""
    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30, check=False)
        except OSError:
            return None
        return done.stdout.rstrip("\n") if done.returncode == 0 else None

    commit = git("rev-parse", "HEAD")
    if commit is None:
        return {}
    changed = [line[3:] for line in (git("status", "--porcelain") or "").split("\n") if line]
    return {"commit": commit, "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(changed), "changed": changed}


def changed_since(folder: str, file: str, seconds: float) -> bool | None:
    """Whether a file of a repository was committed or modified after a time; None without a repository."""
    if not code_state(folder):
        return None
    last = subprocess.run(["git", "-C", folder, "log", "-1", "--format=%ct", "--", file], capture_output=True, text=True, timeout=30, check=False).stdout.strip()
    dirty = any(x == file for x in code_state(folder)["changed"])
    return dirty or (bool(last) and float(last) > seconds)


def log_excerpt(spark: SparkSession, path: str, prefixes: list[str], most: int = 40) -> list[str]:
    """The last lines of a build log that begin with one of the prefixes."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    wanted = reduce(lambda a, b: a | b, [F.col("value").startswith(p) for p in prefixes])
    return [r["value"] for r in reversed(lines.where(wanted).orderBy(F.desc("at")).limit(most).collect())]


class Runner:
    """Writes each stage's table below one folder and reads it back; a stage that is there is not run again."""

    def __init__(self, spark: SparkSession, folder: str, force: bool = False) -> None:
        self.spark, self.folder, self.force = spark, folder.rstrip("/"), force
        self.records: list[dict] = []

    def stage(self, name: str, work: Callable[[], DataFrame], **parameters: object) -> DataFrame:
        path, began = f"{self.folder}/{name}", time.time()
        ran = self.force or not exists(self.spark, path)
        if ran:
            work().write.mode("overwrite").parquet(path)
        out = self.spark.read.parquet(path)
        values = {k: asdict(v) if is_dataclass(v) and not isinstance(v, type) else v for k, v in parameters.items()}
        self.records.append({"stage": name, "ran": ran, "seconds": time.time() - began, "rows": out.count(), "parameters": json.dumps(values, default=str)})
        return out

    def together(self, stages: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """Independent stages at the same time."""
        with ThreadPoolExecutor(len(stages)) as pool:
            return dict(zip(stages, pool.map(lambda s: self.stage(*s), stages.items()), strict=True))

    def manifest(self) -> DataFrame:
        """The stages with row counts, seconds, parameters and the environment."""
        env = {"python": sys.version.split()[0], "spark": self.spark.version, "machine": platform.machine(), "shuffle_partitions": self.spark.conf.get("spark.sql.shuffle.partitions")}
        rows = self.spark.createDataFrame(self.records, "stage string, ran boolean, seconds double, rows long, parameters string")
        return rows.withColumn("environment", F.create_map(*[F.lit(x) for kv in env.items() for x in kv]))


def file_records(spark: SparkSession, path: str, most_bytes: int = 2_147_483_648) -> DataFrame:
    """Path, size, time and md5 (null above most_bytes) of each file."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", "length", "modificationTime", F.when(F.col("length") <= most_bytes, F.md5("content")).alias("md5"))
