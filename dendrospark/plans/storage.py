"""Tables between the steps of iterative jobs, manifests of runs, and resume identity."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; only where a local master has it unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that loops have no growing lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table of the size of a model; more than ``most`` is an error, never a truncation."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def content_id(df: DataFrame) -> str:
    """SHA-256 that depends on the rows of ``df`` but not on their order or partitions."""
    whole = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = df.select(whole.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    # 64-bit sums over four slices of the digests: combined before the shuffle, order-free
    words = [F.sum((F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") * F.col("n"))).alias(f"w{k}") for k in range(4)]
    row = parts.agg(F.sum("n").alias("rows"), *words).first()
    return hashlib.sha256(json.dumps([str(v) for v in row]).encode()).hexdigest()


VOLATILE = frozenset({"out", "resume", "checkpoint", "progress", "budget_seconds", "created"})


def identity(plan: dict[str, Any]) -> str:
    """A run's identity: its plan without the keys that do not change the result."""
    kept = {k: v for k, v in plan.items() if k not in VOLATILE}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder in one step of its file system; false if that was refused."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    return not system.exists(path(target)) and system.rename(path(source), path(target))


def committed(spark: SparkSession, path: str) -> bool:
    """Whether the folder has a manifest."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def save(df: DataFrame, path: str, plan: dict[str, Any], **facts: Any) -> None:
    """A table and its manifest (one JSON row) in a folder that has no manifest yet.

    Data are written under a name of their own and the manifest beside them; renaming the manifest is the last step
    and the only one that readers see.  A run that ends before it leaves unnamed files, and the next may save
    again.  Of two runs at once one is refused.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    if committed(spark, path):
        raise FileExistsError(f"{path} is written already")
    df.write.mode("errorifexists").parquet(f"{path}/data-{run}")
    manifest = {"identity": identity(plan), "plan": plan, "data": f"data-{run}", **facts}
    pending = f"{path}/_pending-{run}"
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(pending)
    if not move(spark, pending, f"{path}/manifest"):
        raise FileExistsError(f"{path} is written already")


def load(spark: SparkSession, path: str, plan: dict[str, Any] | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """A saved table and its manifest; refused if it was saved under another plan."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if plan is not None and manifest["identity"] != identity(plan):
        raise ValueError("the saved run has another plan")
    return spark.read.parquet(f"{path}/{manifest['data']}"), manifest


def kept(spark: SparkSession, folder: str | None, stage: str, plan: dict[str, Any], make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage in a run's folder, made and saved there if it is missing; without a folder just made."""
    if folder is None:
        return make()
    path = f"{folder.rstrip('/')}/{stage}"
    if not committed(spark, path):
        save(make(), path, plan)
    return load(spark, path, plan)[0]
