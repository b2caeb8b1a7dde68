"""The example index as a Parquet table, and as a table of versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.retrieval import build_index, same_length, vector_length
from weftline.session import stored

INDEX_SCHEMA = "example_id bigint, description string, code string, embedding array<float>"


def write_index(index: DataFrame, path: str, append: bool = False) -> None:
    """Write (or extend) the index; missing folders are created. Vectors of another length than the stored ones stop the job."""
    spark = index.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if append and folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        length = vector_length(read_index(spark, path))
        if length is not None:
            index = index.withColumn("embedding", same_length("embedding", length))
    index.write.mode("append" if append else "overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


# -- versions ------------------------------------------------------------------------------------------

VERSIONED_SCHEMA = INDEX_SCHEMA + ", content binary, since int"


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the newest complete version below ``path``, 0 if there is none.

    A version is a folder ``version=<n>``. It is complete when the job that wrote it has left its marker, which is the last thing a job does: until
    then readers see the version before, and a job that fails has changed nothing for them.
    """
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return max((int(status.getPath().getParent().getName().split("=")[1]) for status in found), default=0)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (by default the newest complete one): the columns of an index, ``content`` and ``since``, the version that made the vector."""
    version = version or current_version(spark, path)
    if not version:
        return spark.createDataFrame([], VERSIONED_SCHEMA)
    return spark.read.schema(VERSIONED_SCHEMA).parquet(f"{path}/version={version}")


def _content(df: DataFrame) -> Column:
    """SHA-256 of what an example says; no two pairs of texts are written alike."""
    size = F.coalesce(F.octet_length("description").cast("string"), F.lit("null"))
    return F.unhex(F.sha2(F.concat_ws(":", size, F.coalesce("description", F.lit("")), F.coalesce("code", F.lit("\\0"))), 256))


def reindex(examples: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], tombstones: DataFrame | None = None) -> int:
    """Bring the index at ``path`` up to ``examples`` (example_id, description, code, ...) and return the number of the new version.

    Vectors of examples whose texts are as they were are taken over. ``embed`` adds vectors to the others, new and changed, and to no more. Indexed examples that
    ``examples`` does not hold stay, unless ``tombstones`` (example_id) names them. An example that is named there and given is indexed. Ids must be unique in ``examples``.

    The new version is written beside the old one, which stays as it is and can still be opened by its number. Of two runs at a time the later
    one to start may overwrite the other's version; run one at a time.
    """
    spark = examples.sparkSession
    version = current_version(spark, path)
    before = open_index(spark, path, version)
    given = examples.withColumn("content", _content(examples))
    known = before.select("example_id", F.col("content").alias("_known"))
    stale = given.join(known, "example_id", "left").filter(~F.col("content").eqNullSafe(F.col("_known"))).drop("_known")
    vectors = stored(embed(stale), "new-vectors")
    made = build_index(vectors).join(vectors.select("example_id", "content"), "example_id").withColumn("since", F.lit(version + 1))
    gone = made.select("example_id")
    if tombstones is not None:
        gone = gone.unionByName(tombstones.select(F.col("example_id").cast("bigint")).join(given.select("example_id"), "example_id", "left_anti"))
    kept = before.join(gone, "example_id", "left_anti")
    length = vector_length(kept)
    if length is not None:
        made = made.withColumn("embedding", same_length("embedding", length))
    columns = [c.split()[0] for c in VERSIONED_SCHEMA.split(", ")]
    kept.select(*columns).unionByName(made.select(*columns)).write.mode("overwrite").parquet(f"{path}/version={version + 1}")
    return version + 1
