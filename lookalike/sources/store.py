"""Where tables of a run live, and the shared folder of the cluster."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="lookalike-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    # below the named folder, and with its file system spelled out
    return context.getCheckpointDir()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows by ``by`` in as many tasks as a shuffle has, however few bytes they
    are: for short rows that lead to much work, which sizes do not show. Rows
    that a join or sum has just put together by ``by`` stay where they are, so
    give a stored table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


class RunStore:
    """Tables of one run, one Parquet folder each, below ``root/test_name``.

    ``map_each_image/measures``, ``km/<table>`` and
    ``candidates/<batch>/<table>``. A table that exists is never overwritten,
    unless the run is resumed: a manifest names the tables that were finished,
    with a digest of the settings they were made under. Those are taken as they
    are, and what a broken run left of any other is written again.
    """

    MANIFEST = "name string, settings string"

    def __init__(self, spark: SparkSession, config: Config, resume: bool = False):
        self.spark = spark
        self.config = config
        self.resume = resume
        self.base = f"{config.root.rstrip('/')}/{config.test_name}"
        # which steps run does not change what they make
        made = replace(config, actions=())
        self.settings = hashlib.sha256(repr(made).encode()).hexdigest()

    def _manifest(self) -> str:
        return f"{self.base}/manifest"

    def finish(self, name: str) -> None:
        """Note that a table, or all of a step, is whole."""
        row = self.spark.createDataFrame([(name, self.settings)], self.MANIFEST)
        row.coalesce(1).write.mode("append").parquet(self._manifest())

    def finished(self, name: str) -> bool:
        """Whether a resumed run may take ``name`` as it is."""
        if not self.resume:
            return False
        # an empty table first: there may be no manifest yet
        self.spark.createDataFrame([], self.MANIFEST).write.mode("append").parquet(self._manifest())
        rows = self.spark.read.schema(self.MANIFEST).parquet(self._manifest()).where(F.col("name") == name)
        settings = {r.settings for r in rows.distinct().collect()}
        if settings - {self.settings}:
            raise ValueError(f"{name} was made with other settings; use another test_name")
        return bool(settings)

    def measures_path(self) -> str:
        return f"{self.base}/map_each_image/measures"

    def files_path(self) -> str:
        return f"{self.base}/map_each_image/files"

    def rejected_path(self) -> str:
        return f"{self.base}/map_each_image/rejected"

    def cluster_path(self, table: str) -> str:
        return f"{self.base}/km/{table}"

    def candidate_path(self, table: str) -> str:
        return f"{self.base}/candidates/{self.config.candidate_batch}/{table}"

    def save(self, df: DataFrame, path: str) -> DataFrame:
        """Write once, and hand back the stored table instead of the plan."""
        name = path.removeprefix(f"{self.base}/")
        if not self.finished(name):
            df.write.mode("overwrite" if self.resume else "errorifexists").parquet(path)
            self.finish(name)
        return self.load(path)

    def load(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)


def asset_key(path: Column) -> Column:
    """A file path as one flat name: without slashes, without '._', and
    without one leading dot."""
    flat = F.regexp_replace(path, "/", "")
    flat = F.regexp_replace(flat, r"\._", "")
    return F.regexp_replace(flat, r"^\.", "")


def image_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)
