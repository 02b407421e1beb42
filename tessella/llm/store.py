"""Intermediate tables in the shared folder, row keys, running offsets and joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key of which more than one row in so many is, is hot; there can be no more hot keys than that.
HOT = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a fresh local folder; on a cluster, whose
    machines do not see each other's folders, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}-{tag}"


def persist(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a later loss of executors recomputes from these files, never from the
    steps before them, and columns that later steps do not use are not read.  The files belong to
    the job: results are lazy and may be read again, so they stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that :func:`persist` wrote and that nothing reads any more."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/tessella/"
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        if own.split(":", 1)[-1].lstrip("/") not in folder:
            raise ValueError(f"{folder} is not a table of the shared folder")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variation of it that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of files with nothing but selections over it, so that each of its rows
    is one row of a file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a key that tells rows apart even when they are equal in every column, and its name.

    The key is the row's file and its place there, which no later read changes, however the files
    are dealt out to tasks.  What is not a scan of files is written first, with a number for each row.
    """
    key = free_name(df, "row_key")
    if is_scan(df):
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return df.select("*", place.alias(key)), key
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return persist(df.select("*", number.alias(key)), "keyed"), key


def keep_rows(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``keys``, without the key."""
    return df.join(keys.select(F.col(key)), key, "left_semi").drop(key)


def exclusive_offsets(counts: DataFrame, key: str | list[str], part: str, n: str, out: str) -> DataFrame:
    """Where each part's rows of a key begin, counted over all parts before it.

    ``counts`` has one row per (key, part): the window sorts those, never the rows themselves, so a
    key that holds a third of all rows costs as many rows here as there are parts.
    """
    w = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def looked_up(rows: DataFrame, table: DataFrame, by: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and says in column ``n``
    how many rows have it.

    Keys that more than one row in HOT has are no more than HOT: their rows find them in a broadcast
    and never meet in a task.  The others are joined by a shuffle.  ``table`` and ``rows`` should be
    written tables, as both are read twice.  ``how``: inner or left.  The column ``n`` is left out.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.filter(F.col(n) * HOT > total)
    cold = table.filter(F.col(n) * HOT <= total).drop(n)
    keys = F.broadcast(hot.select(*by))
    near = rows.join(F.broadcast(hot.drop(n)), by)
    return near.unionByName(rows.join(keys, by, "left_anti").join(cold, by, how))
