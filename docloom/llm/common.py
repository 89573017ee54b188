"""What the training-data operators share: written tables in the shared folder, ASCII folding."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of bytes other than these (space, and tab to carriage return).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The first character of each word.
WORD_START = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; ours only where the cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it again.

    This cuts the lineage, gives the optimizer true sizes, and survives lost
    executors. The table goes with `dropped`, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stash_path = jvm_path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `stash` that nothing reads any more: what was made of them must be written itself."""
    for table in tables:
        path = table._stash_path
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a written table up to which one task takes it whole.
LITTLE = 8 << 20


def gathered(table: DataFrame, most: int) -> DataFrame:
    """A table of `stash` in one partition if it takes up to `most` bytes (0: never), so that joins and groups on it need no shuffle; a larger one as it is.

    Rounds over links end with tables of a few rows; dealt out, each of their
    steps would cost a task for every shuffle partition.
    """
    return table.coalesce(1) if most and bytes_of(table) <= most else table


def bytes_of(table: DataFrame) -> int:
    """The size of a table of `stash`."""
    path = table._stash_path
    return path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def sent(table: DataFrame, most: int, of: DataFrame | None = None) -> DataFrame:
    """`table`, marked to be broadcast if it (or the table of `stash` that it was made `of`) takes up to `most` bytes (0: never); else it is shuffled."""
    return F.broadcast(table) if most and bytes_of(table if of is None else of) <= most else table


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is (`lower` alone folds other letters too)."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def removed(text: Column, pattern: str) -> Column:
    """How many characters of `text` the pattern matches: of a pattern of one character, how often it does.

    The text's length less that of what is left; no array of matches is built.
    """
    return F.char_length(text) - F.char_length(F.regexp_replace(text, F.lit(pattern), F.lit("")))


def word_count(text: Column) -> Column:
    """The number of words (WORD_PATTERN); null has none."""
    return removed(F.coalesce(text, F.lit("")), WORD_START).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
