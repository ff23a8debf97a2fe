"""Writing photos sorted into categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions.quality import CATEGORIES
from frameloom.functions.scalar import file_name
from frameloom.operators.ordered import OrderedGroups
from frameloom.session import cut


def _numbered(name, number):
    """Insert _n before the suffix; number 0 keeps the name."""
    ext = F.regexp_extract(name, r"[^.]\.*?(\.[^.]+)$", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(number == 0, name).otherwise(F.concat(base, F.lit("_"), number.cast("string"), ext))


def unique_names(df: DataFrame, path: str, category: str = "category") -> DataFrame:
    """Add ``target``: the file name, made unique inside its category.

    In path order the k-th clash of a name gets _k. A produced name may meet a file that is
    called so already; such clashes are numbered again in the next pass, so every name ends up
    unique, though the numbers can differ from probing one file at a time. A pass that settles nothing is
    not possible: of the files that clash the first keeps its name, so the passes end.
    """
    out = df.withColumn("target", file_name(path))
    while True:
        walk = OrderedGroups(out.withColumn("__own", (F.col("target") != file_name(path)).cast("int")),
                             [category, "target"], [F.col("__own"), F.col(path)]).position("__k")
        out = cut(walk.df.withColumn("target", _numbered(F.col("target"), F.col("__k"))).drop("__k", "__own"))
        clash = out.groupBy(category, "target").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not clash.take(1):
            return out


def write_by_category(df: DataFrame, folder: str, category: str = "category", mode: str = "overwrite") -> None:
    """One sub-folder per category; all four exist even when empty. Sources stay untouched."""
    df.write.mode(mode).partitionBy(category).parquet(folder)
    rest = df.drop(category)
    for name in CATEGORIES:
        rest.sparkSession.createDataFrame([], rest.schema).coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/{category}={name}")
