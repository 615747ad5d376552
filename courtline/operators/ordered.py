"""Running windows that never put a whole key into one task.

A plain window over a key sorts all rows of that key in one task, which fails
when a key (or no key at all) covers most of the table. Here each key is cut
into chunks by one or more *levels*: columns that do not fall as the order
columns rise (a date, then a bucket of ids within the date). Each chunk is
summarised by a partial aggregate, the summaries are prefixed per level, and
the prefix is added to a window that stays inside one chunk. The join to the
prefixes and the window share the partitioning (keys, levels), so the rows are
shuffled once.

The first level's prefix is a window over one row per chunk value of that level
and key, so the first level should have few distinct values (dates, months);
further levels split within it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Spec = tuple[str, Column]


def _last_known(value: Column, order: list[str]) -> Column:
    """Latest non-null value of a chunk, as (order..., v)."""
    return F.max(
        F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order], value.alias("v")))
    )["v"]


def chunk_prefix(
    totals: DataFrame,
    keys: list[str],
    levels: list[str],
    kinds: Mapping[str, str],
) -> DataFrame:
    """Replace each summary column by its combination over all earlier chunks.

    ``kinds`` maps a summary column to "sum", "max" or "last". The result has one
    row per (keys, levels) and columns named ``<name>__before``.
    """
    fold = {
        "sum": lambda c: F.sum(c),
        "max": lambda c: F.max(c),
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    out = totals
    for depth, level in enumerate(levels):
        upper = keys + levels[:depth]
        here = upper + [level]
        deepest = depth == len(levels) - 1
        if deepest:
            step = totals
        else:
            step = totals.groupBy(*here).agg(
                *[_rollup(n, k, levels[depth + 1 :]) for n, k in kinds.items()]
            )
        before = (
            Window.partitionBy(*[F.col(c) for c in upper])
            .orderBy(level)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        step = step.select(
            *here,
            *[fold[k](F.col(n)).over(before).alias(f"{n}__d{depth}") for n, k in kinds.items()],
        )
        out = out.join(step, here) if len(levels) > 1 else step
    return out.select(
        *keys,
        *levels,
        *[_combine(n, k, len(levels)).alias(f"{n}__before") for n, k in kinds.items()],
    )


def _rollup(name: str, kind: str, inner: list[str]) -> Column:
    if kind == "sum":
        return F.sum(name).alias(name)
    if kind == "max":
        return F.max(name).alias(name)
    return _last_known(F.col(name), inner).alias(name)


def _combine(name: str, kind: str, depth: int) -> Column:
    parts = [F.col(f"{name}__d{d}") for d in range(depth)]
    if kind == "sum":
        total = F.coalesce(parts[0], F.lit(0))
        for p in parts[1:]:
            total = total + F.coalesce(p, F.lit(0))
        return total
    if kind == "max":
        return F.greatest(*parts) if depth > 1 else parts[0]
    return F.coalesce(*reversed(parts))


def running(
    df: DataFrame,
    keys: list[str],
    levels: list[str],
    order: list[str],
    *,
    rank: str | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running columns per key in the given order.

    ``rank`` names a 1-based row number, ``sums`` running sums (0 before the first
    row), ``maxes`` running maxima and ``lasts`` the latest non-null value. With
    ``inclusive=False`` the current row is left out (``rank`` is unchanged).
    """
    sums, maxes, lasts = dict(sums or {}), dict(maxes or {}), dict(lasts or {})
    order = [*levels, *[c for c in order if c not in levels]]
    source = df.withColumns(
        {f"{n}__in": c for n, c in {**sums, **maxes, **lasts}.items()}
    )
    group = keys + levels
    parts, kinds = [], {}
    if rank:
        parts.append(F.count(F.lit(1)).alias(rank))
        kinds[rank] = "sum"
    for n in sums:
        parts.append(F.sum(f"{n}__in").alias(n))
        kinds[n] = "sum"
    for n in maxes:
        parts.append(F.max(f"{n}__in").alias(n))
        kinds[n] = "max"
    for n in lasts:
        parts.append(_last_known(F.col(f"{n}__in"), order).alias(n))
        kinds[n] = "last"
    prefixes = chunk_prefix(source.groupBy(*group).agg(*parts), keys, levels, kinds)

    inside = Window.partitionBy(*group).orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = source.join(prefixes, group)
    added: dict[str, Column] = {}
    if rank:
        added[rank] = F.row_number().over(inside) + F.col(f"{rank}__before")
    for n in sums:
        local = F.coalesce(F.sum(f"{n}__in").over(frame), F.lit(0))
        added[n] = F.col(f"{n}__before") + local
    for n in maxes:
        added[n] = F.greatest(F.col(f"{n}__before"), F.max(f"{n}__in").over(frame))
    for n in lasts:
        local = F.last(f"{n}__in", ignorenulls=True).over(frame)
        added[n] = F.coalesce(local, F.col(f"{n}__before"))
    kept = [c for c in df.columns if c not in added]
    return joined.select(*kept, *[c.alias(n) for n, c in added.items()])


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    levels: Mapping[str, Column],
    name: str = "matched",
    strict: bool = True,
) -> DataFrame:
    """Latest ``right`` row of the same keys before (or at) each ``left`` row.

    Both sides are put into one table and the last right-hand struct is carried
    forward, so there is no range join. ``levels`` gives chunk columns as
    expressions over the time column ``__t``. Adds the struct column ``name``
    with the right-hand time as ``at`` and the ``values``; null where none.
    """
    item = F.struct(F.col(right_time).alias("at"), *values)
    facts = right.select(
        *keys, F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__kind"),
        item.alias("__item"), F.lit(None).cast(_struct_of(left)).alias("__row"),
    )
    asks = left.select(
        *keys, F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__kind"),
        F.lit(None).cast(facts.schema["__item"].dataType).alias("__item"),
        F.struct(*left.columns).alias("__row"),
    )
    both = facts.unionByName(asks).withColumns(dict(levels))
    carried = running(
        both, keys, list(levels), ["__t", "__kind"], lasts={name: F.col("__item")}
    )
    return carried.filter(F.col("__row").isNotNull()).select("__row.*", name)


def _struct_of(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def segments(
    intervals: DataFrame, keys: list[str], low: str, high: str, width: int, pick: list[str], values: list[str]
) -> DataFrame:
    """(keys, __bucket, __t, __side, __hit): each stretch of a bucket with the first interval that covers it.

    A stretch starts at an interval's low (side 0) or just behind its high (side 1) and lasts to
    the next start; ``__hit`` is the smallest (pick, values) struct over it, or null. Intervals of
    equal bounds are one before they are listed, so a list holds distinct bounds only.
    """
    spread = intervals.filter(F.col(low) <= F.col(high)).select(
        *keys, F.col(low).alias("__low"), F.col(high).alias("__high"),
        F.struct(*pick, *[c for c in values if c not in pick]).alias("__hit"),
        F.explode(
            F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
        ).alias("__bucket"),
    )
    listed = (
        spread.groupBy(*keys, "__bucket", "__low", "__high").agg(F.min("__hit").alias("__hit"))
        .groupBy(*keys, "__bucket").agg(F.collect_list(F.struct("__low", "__high", "__hit")).alias("__all"))
    )

    def marks(x: Column) -> Column:
        return F.array(
            F.struct(x["__low"].alias("t"), F.lit(0).alias("side")), F.struct(x["__high"].alias("t"), F.lit(1).alias("side"))
        )

    def covers(x: Column, m: Column) -> Column:
        return (x["__low"] <= m["t"]) & ((x["__high"] > m["t"]) | ((m["side"] == 0) & (x["__high"] == m["t"])))

    def stretch(m: Column) -> Column:
        over = F.transform(F.filter("__all", lambda x: covers(x, m)), lambda x: x["__hit"])
        return F.struct(m["t"].alias("__t"), m["side"].alias("__side"), F.array_min(over).alias("__hit"))

    starts = F.array_distinct(F.flatten(F.transform("__all", marks)))
    return listed.select(*keys, "__bucket", F.explode(F.transform(starts, stretch)).alias("__s")).select(
        *keys, "__bucket", "__s.*"
    )


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str,
    low: str,
    high: str,
    width: int,
    pick: list[str],
    values: list[str],
    name: str = "matched",
) -> DataFrame:
    """First interval (by ``pick``) with low <= point <= high and equal keys.

    Intervals are cut into ``segments`` per bucket of ``width``. The distinct points of a bucket
    and its segments are put in order and the last segment is carried forward; then the
    points look their own value up. No point meets more than one row, and only distinct values
    pass through a window. Points that meet no interval keep a null ``name``.
    """
    cut = segments(intervals, keys, low, high, width, pick, values)
    facts = cut.withColumns({"__kind": F.lit(0), "__found": F.struct("__hit")}).drop("__hit")
    asks = points.select(*keys, F.col(point).alias("__t")).distinct().select(
        *keys, F.floor(F.col("__t") / width).alias("__bucket"), "__t", F.lit(0).alias("__side"), F.lit(1).alias("__kind"),
        F.lit(None).cast(facts.schema["__found"].dataType).alias("__found"),
    )
    line = Window.partitionBy(*keys, "__bucket").orderBy("__t", "__side", "__kind")
    carried = facts.unionByName(asks).withColumn("__found", F.last("__found", ignorenulls=True).over(line))
    told = carried.filter("__kind = 1").select(*keys, F.col("__t").alias(point), F.col("__found.__hit").alias(name))
    return points.join(told, [*keys, point], "left").select(*points.columns, name)
