"""Ordered scans inside groups that stay parallel when one group is huge.

A plain window puts a whole group into one task. That is the cheapest plan while
groups are ordinary, and the wrong one when a single project holds a third of all
rows. ``OrderedGroups`` measures the group sizes first. Ordinary groups use the
plain window. Rows of a hot group are range-partitioned by their order key, so each
slot is bounded; windows run per slot, and one small row per slot carries the
running state (count, sum, last value) into the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.session import cut

# A group is hot above this many rows: what one task sorts with ease.
HOT_ROWS = 2_000_000
# Hashes by which rows are counted to find hot groups.
MARKS = 4_096

_SLOT = "__slot"


class HotGroups:
    """Keys of the groups too big for one task, as a table of their own; false if there are none."""

    def __init__(self, keys: DataFrame | None, some: bool) -> None:
        self.keys, self.some = keys, some

    def __bool__(self) -> bool:
        return self.some


def hot_groups(df: DataFrame, by: Sequence[str], hot_rows: int | None = None) -> HotGroups:
    """All groups of more than ``hot_rows`` rows; the keys stay in Spark, however many there are.

    Rows are counted by a hash of their key first, of which a task sends at most ``MARKS``; a hash with few rows has no
    hot key, so keys are counted only under the others.
    """
    floor = HOT_ROWS if hot_rows is None else hot_rows
    if not by:
        return HotGroups(None, df.count() > floor)
    mark = F.pmod(F.xxhash64(*by), F.lit(MARKS))
    marks = df.groupBy(mark.alias("__mark")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > floor)
    busy = [r[0] for r in marks.select("__mark").collect()]  # at most MARKS numbers
    if not busy:
        return HotGroups(None, False)
    sizes = df.filter(mark.isin(busy)).groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > floor)
    return listed_groups(sizes.select(*by))


def listed_groups(keys: DataFrame) -> HotGroups:
    return HotGroups(keys, bool(keys.take(1)))


class OrderedGroups:
    """Rows of ``df`` in ``order`` inside each ``by`` group.

    ``order`` must be a strict order inside a group (end it with a unique key). Each
    method adds a column and returns ``self``; ``df`` is the result so far. Callers that know the
    hot groups already, measured on these rows or a superset, or that have bounded the groups
    themselves, pass ``hot`` and save the counting job.
    """

    def __init__(
        self,
        df: DataFrame,
        by: Sequence[str],
        order: Sequence[Column],
        hot_rows: int | None = None,
        hot: HotGroups | None = None,
    ) -> None:
        self.by = list(by)
        self.order = list(order)
        if hot is None:
            hot = hot_groups(df, self.by, hot_rows)
        self.sliced = bool(hot)
        self.columns = df.columns
        if self.sliced:
            df = self._slice(df, hot)
        self._df = df

    def _slice(self, df: DataFrame, hot: HotGroups) -> DataFrame:
        if self.by:
            names = [f"__hot_k{i}" for i in range(len(self.by))]
            keys = hot.keys.select(*[F.col(c).alias(k) for c, k in zip(self.by, names)], F.lit(True).alias("__hot"))
            on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(self.by, names)]
            tagged = df.join(keys, on, "left").drop(*names)
            cold = tagged.filter(F.col("__hot").isNull()).drop("__hot").withColumn(_SLOT, F.lit(-1))
            busy = tagged.filter(F.col("__hot")).drop("__hot")
        else:
            cold, busy = None, df
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = busy.repartitionByRange(
            max(parts, 4), *[F.col(c) for c in self.by], *self.order
        ).withColumn(_SLOT, F.spark_partition_id())
        # The slot numbers are only meaningful for this one shuffle: pin them.
        ranged = cut(ranged)
        return ranged if cold is None else cold.unionByName(ranged)

    # -- windows ----------------------------------------------------------- #
    def _local(self):
        keys = self.by + ([_SLOT] if self.sliced else [])
        return Window.partitionBy(*keys).orderBy(*self.order)

    def _carry(self, aggs: list[Column], carried: list[tuple[str, Column]]) -> DataFrame:
        """Add to every hot row the state carried in from the earlier slots of its group.

        One row per (hot group, slot) is aggregated; ordinary groups have no slots. A slot is a bounded part
        of a group, so the join meets no hot key.
        """
        names = [f"__carry_k{i}" for i in range(len(self.by))]
        keys = [F.col(c).alias(k) for c, k in zip(self.by, names)]
        slots = (
            self._df.filter(F.col(_SLOT) >= 0)
            .groupBy(*keys, F.col(_SLOT).alias("__carry_slot"))
            .agg(*aggs)
        )
        before = Window.partitionBy(*names).orderBy("__carry_slot").rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = slots.select(*names, "__carry_slot", *[e.over(before).alias(n) for n, e in carried])
        left = self._df
        on = [left[_SLOT] == carry["__carry_slot"]]
        on += [left[c].eqNullSafe(carry[k]) for c, k in zip(self.by, names)]
        return left.join(carry, on, "left").drop("__carry_slot", *names)

    # -- columns ----------------------------------------------------------- #
    def position(self, name: str = "pos") -> OrderedGroups:
        """Zero-based place of the row in its group."""
        local = F.row_number().over(self._local()).cast("long") - 1
        if not self.sliced:
            self._df = self._df.withColumn(name, local)
            return self
        joined = self._carry([F.count(F.lit(1)).alias("__carry_n")], [("__carry_in", F.sum("__carry_n"))])
        self._df = (
            joined.withColumn(name, local + F.coalesce(F.col("__carry_in"), F.lit(0)))
            .drop("__carry_in")
        )
        return self

    def running_sum(self, value: Column, name: str) -> OrderedGroups:
        """Inclusive running sum of ``value``."""
        window = self._local().rowsBetween(Window.unboundedPreceding, 0)
        if not self.sliced:
            self._df = self._df.withColumn(name, F.sum(value).over(window))
            return self
        self._df = self._df.withColumn("__carry_v", value)
        joined = self._carry([F.sum("__carry_v").alias("__carry_s")], [("__carry_in", F.sum("__carry_s"))])
        self._df = (
            joined.withColumn(name, F.sum("__carry_v").over(window) + F.coalesce("__carry_in", F.lit(0)))
            .drop("__carry_v", "__carry_in")
        )
        return self

    def previous(self, column: str, name: str) -> OrderedGroups:
        """Value of ``column`` on the row before; null on the first row of a group."""
        if not self.sliced:
            self._df = self._df.withColumn(name, F.lag(column).over(self._local()))
            return self
        # The last row of a slot: its local position is the slot size minus one.
        tagged = self._df.withColumn("__carry_rn", F.row_number().over(self._local()))
        self._df = tagged
        last = F.max(F.struct(F.col("__carry_rn"), F.col(column).alias("__carry_v"))).alias("__carry_last")
        joined = self._carry([last], [("__carry_in", F.last("__carry_last"))])
        self._df = (
            joined.withColumn(
                name,
                F.when(F.col("__carry_rn") == 1, F.col("__carry_in")["__carry_v"]).otherwise(
                    F.lag(column).over(self._local())
                ),
            )
            .drop("__carry_rn", "__carry_in")
        )
        return self

    def with_column(self, name: str, value: Column) -> OrderedGroups:
        self._df = self._df.withColumn(name, value)
        return self

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_SLOT)


# Up to here Spark prunes row_number() <= n on the map side, before the shuffle.
MAP_SIDE_LIMIT = 1_000


def top_n(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, salts: int = 64
) -> DataFrame:
    """First ``n`` rows per group; a hot group never meets in one task.

    For a small ``n`` every map task already sends at most n rows per group. A larger one takes
    two steps: n rows per (group, salt), then at most n * salts rows per group.
    """
    by = list(by)
    if n <= 0:
        return df.limit(0)
    every = Window.partitionBy(*by).orderBy(*order)
    if n > MAP_SIDE_LIMIT:
        plain = [F.col(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
        some = Window.partitionBy(*by, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
            .withColumn("__rn", F.row_number().over(some)).filter(F.col("__rn") <= n).drop("__salt", "__rn")
        )
    return df.withColumn("__rn", F.row_number().over(every)).filter(F.col("__rn") <= n).drop("__rn")


def first_row(df: DataFrame, by: Sequence[str], key: Column, largest: bool = False) -> DataFrame:
    """One row per group, the one with the smallest (largest) ``key``.

    ``min_by`` combines on the map side, so this never moves a whole group.
    """
    pick = F.max_by if largest else F.min_by
    rest = [c for c in df.columns if c not in by]
    row = pick(F.struct(*rest), key).alias("__row")
    return df.groupBy(*by).agg(row).select(*by, *[F.col("__row")[c].alias(c) for c in rest])


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], step, schema: str) -> DataFrame:
    """Run a sequential rule over rows sorted inside each key, batch by batch.

    ``step(state, row) -> (state, out_row)`` sees one row at a time; ``state`` is None on
    the first row of a key. Partitions stream through, so no key is held in memory.
    Cut long keys into independent runs first and make the run number part of ``keys``.
    """
    import pandas as pd

    keys, order = list(keys), list(order)

    def run(batches):
        current, state = None, None
        for pdf in batches:
            out = []
            names = list(pdf.columns)
            key_at = [names.index(k) for k in keys]
            for values in pdf.itertuples(index=False, name=None):
                key = tuple(values[i] for i in key_at)
                if key != current:
                    current, state = key, None
                state, produced = step(state, dict(zip(names, values)))
                out.append(produced)
            yield pd.DataFrame(out)

    placed = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)
