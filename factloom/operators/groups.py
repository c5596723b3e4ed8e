"""Ordered work inside groups, when one group may be larger than a task should hold.

A window partitioned by a key puts all rows of that key into one task.  For
ordinary keys that is the cheapest plan: one shuffle and one sort.  A key that
holds a large part of the table needs another way, so groups are measured first
(a count with map-side combine) and rows of oversized groups take a second path:

1. they are range-partitioned on (keys, order), which cuts a group into
   consecutive buckets of bounded size, and the bucket number is pinned with a
   reliable checkpoint, so a lost executor cannot move a boundary;
2. windows run per (keys, bucket);
3. what one bucket needs to know about earlier ones (row count, running total,
   last row) is one small row per bucket, combined over the buckets of a group
   and joined back on (keys, bucket).

Results of both paths are the same, and nothing is dropped or sampled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows, and bytes where a caller says how to count them, of one group that a single task
#: is trusted with.
GROUP_ROW_LIMIT = 1_000_000
GROUP_BYTE_LIMIT = 512 * 1024 * 1024

_BUCKET = "_bucket"


def group_sizes(frame: DataFrame, keys: Sequence[str], size: Column | None = None) -> DataFrame:
    """Rows (``_rows``) and bytes (``_bytes``) of each group; ``size`` is what a row adds."""
    weight = F.lit(0) if size is None else F.coalesce(size, F.lit(0))
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(weight.cast("long")).alias("_bytes")
    )


def within_limits(
    frame: DataFrame, keys: Sequence[str], row_limit: int, byte_limit: int, size: Column
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups within both limits, and the keys of all others, pinned; None if there are none."""
    sizes = group_sizes(frame, keys, size)
    large = sizes.filter((F.col("_rows") > row_limit) | (F.col("_bytes") > byte_limit)).select(*keys)
    if large.isEmpty():
        return frame, None
    ensure_checkpoint_dir(frame.sparkSession)
    large = large.checkpoint()
    return frame.join(large, list(keys), "left_anti"), large


@dataclass(frozen=True)
class _Part:
    frame: DataFrame
    cut: bool


@dataclass(frozen=True)
class OrderedGroups:
    """Rows grouped by ``keys`` (never null) and ordered inside a group.

    ``order`` must be total within a group for results to be repeatable.
    """

    parts: tuple[_Part, ...]
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @classmethod
    def of(
        cls,
        frame: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        row_limit: int = GROUP_ROW_LIMIT,
        measured: DataFrame | None = None,
        size: Column | None = None,
        byte_limit: int = GROUP_BYTE_LIMIT,
        dealt: Sequence[str] | None = None,
    ) -> OrderedGroups:
        """Group ``frame``, cutting the groups that are larger than ``row_limit``.

        ``measured`` names a cheaper table whose groups are at least as large, such
        as the one ``frame`` was filtered from; sizes are then taken there.  ``size``
        is the number of bytes that a row adds to its group; groups of more than
        ``byte_limit`` bytes are cut too.  ``dealt`` names those of ``keys`` that later
        joins are on: rows are dealt by them alone, so such a join needs no other
        shuffle, and sizes are taken of all groups that share them.
        """
        keys, order = tuple(keys), tuple(order)
        dealt = keys if dealt is None else tuple(dealt)
        sizes = group_sizes(frame if measured is None else measured, dealt, size)
        oversized = sizes.filter((F.col("_rows") > row_limit) | (F.col("_bytes") > byte_limit))
        rows, weighed = oversized.agg(F.sum("_rows"), F.sum("_bytes")).first()
        if not rows:
            return cls.ordinary(frame, keys, order, dealt)

        ensure_checkpoint_dir(frame.sparkSession)
        hot_keys = oversized.select(*dealt).checkpoint()
        buckets = max(-(-rows * 2 // row_limit), -(-weighed * 2 // byte_limit))
        cold = cls.ordinary(frame.join(hot_keys, list(dealt), "left_anti"), keys, order, dealt)
        hot = (
            frame.join(hot_keys, list(dealt), "left_semi")
            .repartitionByRange(buckets, *keys, *order)
            .withColumn(_BUCKET, F.spark_partition_id())
            .checkpoint()
        )
        return cls((*cold.parts, _Part(hot, True)), keys, order)

    @classmethod
    def ordinary(
        cls, frame: DataFrame, keys: Sequence[str], order: Sequence[str],
        dealt: Sequence[str] | None = None,
    ) -> OrderedGroups:
        """Groups that are known to be small enough for one task each; see :meth:`of`."""
        keys = tuple(keys)
        if dealt is not None and tuple(dealt) != keys:
            frame = frame.repartition(*dealt)
        return cls((_Part(frame, False),), keys, tuple(order))

    def frame(self) -> DataFrame:
        """All rows, with the columns added so far."""
        return reduce(
            DataFrame.unionByName, [p.frame.drop(_BUCKET) if p.cut else p.frame for p in self.parts]
        )

    def position(self, name: str, start: int = 1) -> OrderedGroups:
        """Add the row number within the group."""

        def add(part: _Part, rows: Window) -> DataFrame:
            frame = part.frame.withColumn(name, F.row_number().over(rows) + F.lit(start - 1))
            if part.cut:
                earlier = self._earlier(part.frame, F.count(F.lit(1)))
                frame = self._carry(frame, earlier).withColumn(
                    name, (F.col(name) + F.col("_earlier")).cast("int")
                )
            return frame.drop("_earlier")

        return self._each(add)

    def running_sum(self, name: str, value: Column) -> OrderedGroups:
        """Add the sum of ``value`` over the rows up to and including this one."""

        def add(part: _Part, rows: Window) -> DataFrame:
            upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            frame = part.frame.withColumn(name, F.sum(value).over(upto))
            if part.cut:
                earlier = self._earlier(part.frame, F.sum(value))
                frame = self._carry(frame, earlier).withColumn(
                    name, F.col(name) + F.col("_earlier")
                )
            return frame.drop("_earlier")

        return self._each(add)

    def previous(self, columns: dict[str, str]) -> OrderedGroups:
        """Add values of the row before: ``{new column: source column}``; null on the first."""

        def add(part: _Part, rows: Window) -> DataFrame:
            frame = part.frame.withColumns(
                {new: F.lag(source).over(rows) for new, source in columns.items()}
            )
            if not part.cut:
                return frame
            buckets = Window.partitionBy(*self.keys).orderBy(_BUCKET)
            last = F.max_by(F.struct(*columns.values()), F.struct(*self.order))
            edges = (
                part.frame.groupBy(*self.keys, _BUCKET)
                .agg(last.alias("_last"))
                .withColumn("_last", F.lag("_last").over(buckets))
            )
            first_in_bucket = F.row_number().over(rows) == 1
            frame = self._carry(frame.withColumn("_first", first_in_bucket), edges)
            return frame.withColumns(
                {
                    new: F.when(F.col("_first"), F.col("_last")[source]).otherwise(F.col(new))
                    for new, source in columns.items()
                }
            ).drop("_first", "_last")

        return self._each(add)

    def reorder(self, order: Sequence[str], row_limit: int = GROUP_ROW_LIMIT) -> OrderedGroups:
        """The same rows in another order; only oversized groups are cut anew."""
        parts: list[_Part] = []
        for part in self.parts:
            if part.cut:
                again = OrderedGroups.of(part.frame.drop(_BUCKET), self.keys, order, row_limit)
                parts.extend(again.parts)
            else:
                parts.append(part)
        return replace(self, parts=tuple(parts), order=tuple(order))

    def join_text(
        self, text: Column, separator: str, name: str, position: str, **totals: Column
    ) -> DataFrame:
        """One row per group: its texts joined in order, plus aggregates of the rows.

        ``position`` is a column from :meth:`position`.  An oversized group is
        joined bucket by bucket, and the last step only strings the pieces
        together.  ``totals`` must be aggregates that :data:`MERGE` can combine
        (named ``sum_*``, ``count_*``, ``min_*`` or ``max_*``).
        """
        listed = F.collect_list(F.struct(F.col(position).alias("at"), text.alias("text")))
        joined = F.array_join(
            F.transform(F.sort_array(listed), lambda row: row["text"]), separator
        ).alias(name)
        aggregates = [column.alias(label) for label, column in totals.items()]

        def collapse(part: _Part) -> DataFrame:
            if not part.cut:
                return part.frame.groupBy(*self.keys).agg(joined, *aggregates)
            pieces = part.frame.groupBy(*self.keys, _BUCKET).agg(joined, *aggregates)
            ordered = F.sort_array(F.collect_list(F.struct(_BUCKET, name)))
            return pieces.groupBy(*self.keys).agg(
                F.array_join(F.transform(ordered, lambda row: row[name]), separator).alias(name),
                *[MERGE[label.split("_")[0]](label).alias(label) for label in totals],
            )

        return reduce(DataFrame.unionByName, [collapse(part) for part in self.parts])

    def _each(self, add) -> OrderedGroups:
        done = []
        for part in self.parts:
            keys = (*self.keys, _BUCKET) if part.cut else self.keys
            rows = Window.partitionBy(*keys).orderBy(*self.order)
            done.append(_Part(add(part, rows), part.cut))
        return replace(self, parts=tuple(done))

    def _earlier(self, frame: DataFrame, aggregate: Column) -> DataFrame:
        """Per bucket, the aggregate summed over the earlier buckets of its group."""
        before = (
            Window.partitionBy(*self.keys)
            .orderBy(_BUCKET)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        per_bucket = frame.groupBy(*self.keys, _BUCKET).agg(aggregate.alias("_here"))
        return per_bucket.select(
            *self.keys, _BUCKET, F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_earlier")
        )

    def _carry(self, frame: DataFrame, per_bucket: DataFrame) -> DataFrame:
        return frame.join(per_bucket, [*self.keys, _BUCKET])


#: How aggregates of buckets combine into that of their group.
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
