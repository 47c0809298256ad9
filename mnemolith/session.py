"""Sessions: settings that results depend on, and the package itself on every executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may leave ``spark.checkpoint.dir`` unset; it gets a folder of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="shared-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in that folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_off(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the folder that all executors share: its lineage ends there.

    Spark hands a checkpoint the estimate and the constraints of the plan that made it. A join's estimate is the product of its sides', so in
    rounds of joins its digits multiply with every round until the driver does nothing but that; here the size of the files takes its place."""
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    plan, jvm = done._jdf.queryExecution().analyzed(), spark._jvm
    files = jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    size = files.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(files).getLength()
    # The estimate of a range of as many bytes: a call from here cannot make one of its own.
    estimate = spark.range(size // 8 + 1)._jdf.queryExecution().analyzed().stats()
    some, none = jvm.scala.Option.apply(estimate), jvm.scala.Option.empty()
    session = done._jdf.sparkSession()
    own = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), none, session, some, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, own), spark)


#: Up to so many bytes, by the plan's own estimate, rows are dealt out anew before dear work on their texts.
SMALL_TABLE = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: its file may be a single split. A larger one has splits enough, and stays where it is."""
    about = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if about <= SMALL_TABLE else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


#: Most rows and bytes that go to or from a Python worker at once, where the session says nothing else.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Spark keeps a pool of Python workers for each environment, and this setting is the only difference between those of DataFrames and of RDDs.
ONE_POOL = {"spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """What every query needs: UTC, small batches for Python workers, one pool of these, and the package on them."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name, value in (ARROW | ONE_POOL).items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    ship_package(spark)
    return spark
