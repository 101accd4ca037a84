"""Tables and folders that every executor and the driver can see.

Intermediate results are written to the folder named by ``spark.checkpoint.dir``, so a lost
executor costs a re-read and never a wrong or missing row.  Only where that setting is absent
and Spark runs in one process (tests, notebooks) is a local folder of our own used, which goes with the
process; what is written to a shared folder stays until its owner clears it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []
#: What was written inside each open ``scratch``, the innermost last.
_scratch: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the shared scratch folder, read from the session on every call."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor sees")
        if not _own_root:
            folder = tempfile.mkdtemp(prefix="tracelake-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own_root.append("file://" + folder)
        root = _own_root[0]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_root(spark)}/tracelake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    This cuts the lineage and gives the optimizer real sizes; both sides of a later join are then
    plain shuffles, which adaptive execution can split when one key is hot.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are materialized inside go when it ends without an error, but for those taken out of the list that it yields.

    Nothing that was made of them may be read later, so what is to stay is written inside and taken out.
    """
    held: list[str] = []
    _scratch.append(held)
    try:
        yield held
    finally:
        _scratch.remove(held)
    for path in held:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
