"""What the operators share: the word rule, shared-folder tables and row identity."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators between words, as a Java and as a Python pattern.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text (null: none), inside the JVM."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: inside a lambda, an outer expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="keytide-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/keytide-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read back: lineage ends here, and lost executors cost a re-read.

    Returns the table and its path, for delete().
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def named_rows(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs, and a column that names each of its rows, the same in every later reading.

    Rows of a file scan, with nothing but deterministic filters and projections above it, are named by file and place in
    the file, so nothing is copied. Any other DataFrame may give its rows in another order when it is computed
    again; it is written to the shared folder first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while True:
        kind = plan.getClass().getSimpleName()
        if kind not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation") or not plan.deterministic():
            break
        if kind == "LogicalRelation":
            if plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet":
                at = docs.metadataColumn("_metadata")
                return docs, F.struct(F.xxhash64(at["file_path"]).alias("file"), F.crc32(at["file_path"]).alias("more"), at["row_index"].alias("row"))
            break
        plan = plan.children().head()
    table, _ = stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")), "rows")
    at = table.metadataColumn("_metadata")
    name = F.struct(F.xxhash64(at["file_path"]).alias("file"), F.crc32(at["file_path"]).alias("more"), at["row_index"].alias("row"))
    return table.select("row.*"), name
