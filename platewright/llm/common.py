"""What the operators of this subpackage share: input tables, scratch tables in the shared folder, column checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java's and RE2's form of the ASCII white space U+0020, U+0009..U+000D.
SPACE = r"[ \t\n\x0B\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where that is unset, as in local tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="platewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended; a scratch table that stays does no harm
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/platewright/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: Whether Spark removes the shuffle files of a query when it ends; else they wait for the driver's garbage collector.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's number of partitions of a shuffle.
PARTITIONS = "spark.sql.shuffle.partitions"


def one_file_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, raised to that from which Spark sorts a task's rows into one file, if it is not far below it.

    With fewer a task opens, copies and removes a file for each partition, which costs more than the rows of a small shuffle.
    """
    n, most = int(spark.conf.get(PARTITIONS)), int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return most + 1 if most // 2 < n <= most else n


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, a lost executor costs no recomputation, and the shuffle files go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    meanwhile = {CLEANUP: "true", PARTITIONS: str(one_file_partitions(spark))}
    before = {k: spark.conf.get(k, None) for k in meanwhile}
    try:
        for k, v in meanwhile.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table of a DataFrame that ``written`` gave; nothing that is still to run may read it."""
    _remove(df.sparkSession, df.scratch_path)


def named(col: str) -> Column:
    """The column of that name, dots and blanks in it included."""
    return F.col("`" + col.replace("`", "``") + "`")


def carrying(docs: DataFrame, prefix: str, keep) -> DataFrame:
    """keep(docs), with those columns of docs renamed meanwhile that start like the work columns of ``keep``."""
    taken, names = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower().startswith(prefix):
            new = f"c{c}"
            while new.lower() in taken:
                new = f"c{new}"
            taken.add(new.lower())
            names[c] = new
    if not names:
        return keep(docs)
    out, back = keep(docs.select(*(named(c).alias(names.get(c, c)) for c in docs.columns))), {new: c for c, new in names.items()}
    return out.select(*(named(c).alias(back.get(c, c)) for c in out.columns))


def text_of(col: str) -> Column:
    return F.coalesce(named(col), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
