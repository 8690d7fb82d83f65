"""Expressions and helpers that the training-data operators share.

Everything here is built from DataFrame functions, so an operator that uses only this module stays in the JVM.
"""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition ``[^\x20\x09-\x0D]+``. Single characters, not a range: Java's matcher keeps
#: single Latin-1 characters in one bit set, which is several times faster than a chain of ranges.
SPACE = r" \t\n\x0B\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A cut may always have so many files.
FILES = 64


def whole(text: Column | str) -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    A text of ASCII characters takes the fast built-in ``lower``; any other is cut into ASCII and other runs, and
    only the ASCII ones are lowered, so that letters such as U+00C9 stay as they are.
    """
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    lowered = F.transform(runs, lambda part: F.when(F.ascii(part) < 128, F.lower(part)).otherwise(part))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.array_join(lowered, ""))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array if it has none."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def md5_int(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a long: a hash that DuckDB and Python can reproduce."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has a folder.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``; without one this raises. Only where
    driver and executors are one process, as in tests, a private folder is set instead.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="phasegrid-checkpoint-"))


def packed(df: DataFrame) -> DataFrame:
    """The same rows in at most an eighth of the shuffle partitions (``FILES``, or three a core, if that is more), to be written.

    Hadoop's local file system starts ``chmod`` for each file and each checksum file that it writes. Until such a process
    runs its program it maps all of its executor's memory, which is then counted twice where processes are added up; the
    larger the input, the more files there are. Tasks take several partitions one after another: no rows are moved.
    """
    spark = df.sparkSession
    return df.coalesce(max(FILES, 3 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 8))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that later stages neither recompute nor lose them."""
    checkpoint_dir(df.sparkSession)
    return packed(df).checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that were cut: they stay on disk until the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Rows with the columns of their group, or nulls; ``size`` is a group's number of rows out of ``total``.

    Groups that hold more than a thousandth of all rows are fewer than a thousand, so they are broadcast and no task
    gets all rows of one; the others meet by shuffle. Both tables are read twice: cut them before.
    """
    large = F.col(size) * 1000 > total
    hot = F.broadcast(groups.where(large))
    rest = rows.join(hot.select(*on), on, "left_anti").join(groups.where(~large), on, "left")
    return rows.join(hot, on).unionByName(rest)
