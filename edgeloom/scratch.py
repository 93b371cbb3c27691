"""Intermediate tables and folders that every executor and the driver can reach.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost executor costs a reread and never a
recomputation of the whole job. The setting is read from the session; only where it is unset and the session is a local
one (tests) is a temporary folder made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """URI of this application's scratch folder, below the shared one."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="edgeloom-")
        _OWN[app] = f"{base.rstrip('/')}/edgeloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clear, spark, app)
    return _OWN[app]


def _clear(spark: SparkSession, app: str) -> None:
    try:
        drop(spark, _OWN[app])
    except Exception:  # the JVM may be gone by now
        pass


def path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop(spark: SparkSession, where: str) -> None:
    """Delete a scratch path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(where)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the scratch folder; the frame that reads it, and its path."""
    where = path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where), where
