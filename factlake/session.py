"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_OWN_FOLDER = "spark.factlake.folder"
_OWNER: ContextVar[Scratch | None] = ContextVar("owner", default=None)


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings these jobs are written for."""
    builder = SparkSession.builder.appName("factlake")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose one machine sees every folder, may leave it unset; it gets
    a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    if folder is None:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factlake-")
        spark.conf.set(_OWN_FOLDER, folder)
    return folder


def materialized(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut.

    Unlike an RDD checkpoint the table is columnar, so later steps read only the
    columns they use, and it outlives the executors that wrote it. Inside
    ``temporary_tables`` it is dropped at the end.
    """
    if (owner := _OWNER.get()) is not None:
        return owner.table(df)
    path = f"{shared_folder(df.sparkSession)}/factlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, path: str, buckets: int, *by: str) -> None:
    """``df`` below ``path``, the rows of equal ``by`` in one of so many files."""
    name = f"factlake_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by)
    writer.option("path", path).format("parquet").saveAsTable(name)
    # The files stay: a table with a path of its own is only known to the catalog.
    df.sparkSession.sql(f"DROP TABLE {name}")


def bucketed_table(
    spark: SparkSession, path: str, schema: StructType, buckets: int, *by: str
) -> DataFrame:
    """What ``write_bucketed`` has written; joins and groupings on ``by`` don't shuffle it."""
    name = f"factlake_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema.toDDL()}) USING parquet "
        f"CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(by)}) INTO {buckets} BUCKETS "
        f"LOCATION '{path}'"
    )
    table = spark.table(name)
    # The files stay, and the frame knows them: nothing looks the name up again.
    spark.sql(f"DROP TABLE {name}")
    return table


class Scratch:
    """Tables in the shared folder that are dropped as soon as nothing reads them any more.

    ``table`` is ``materialized`` with an owner; ``drop`` deletes tables whose readers have
    been written. The last table, which the caller of a job reads, stays: Spark can't know
    when its rows have been consumed.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._folder = f"{shared_folder(spark)}/factlake/{uuid.uuid4().hex}"
        self._tables: list[tuple[DataFrame, str, str | None]] = []

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{len(self._tables)}"
        df.write.parquet(path)
        written = self._spark.read.schema(df.schema).parquet(path)
        self._tables.append((written, path, None))
        return written

    def bucketed(self, df: DataFrame, *by: str) -> DataFrame:
        """``table`` with the rows of equal ``by`` in one file: joins on it don't move them.

        One file per shuffle partition, which is how a grouping by ``by`` has its rows anyway.
        """
        path = f"{self._folder}/{len(self._tables)}"
        number = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"factlake_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(number, *by).sortBy(*by).format("parquet")
        writer.option("path", path).saveAsTable(name)
        written = self._spark.table(name)
        self._tables.append((written, path, name))
        return written

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables of this owner; a table that isn't its own is left alone."""
        for df in tables:
            for written, path, name in self._tables:
                if written is df:
                    if name:
                        self._spark.sql(f"DROP TABLE IF EXISTS {name}")
                    drop_folder(self._spark, path)

    def drop_all(self, *but: DataFrame) -> None:
        """Delete every table of this owner except ``but``."""
        self.drop(*[t for t, _, _ in self._tables if not any(t is b for b in but)])


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Scratch]:
    """Every table that jobs leave in the shared folder inside the block is dropped after it.

    For a consumer that writes what it wants to keep, as a micro-batch does::

        with temporary_tables(spark):
            verify_answers(answers, index).reports.write.parquet(path)
    """
    owner = Scratch(spark)
    token = _OWNER.set(owner)
    try:
        yield owner
    finally:
        _OWNER.reset(token)
        owner.drop_all()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def written_once(spark: SparkSession, make: Callable[[], DataFrame], path: str) -> DataFrame:
    """The table at ``path``, made and written if no earlier run has finished writing it.

    Spark's own mark of a finished write tells a whole table from what a killed run left.
    """
    if not _exists(spark, f"{path}/_SUCCESS"):
        with temporary_tables(spark):
            make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, through Spark's own file systems: any store will do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
