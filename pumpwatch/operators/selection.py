"""Order statistics without an order: ranks are found by narrowing value ranges with counts.

``median`` of many groups at once: each group keeps the range of values that its
middle rows are in. A pass over the rows counts, for every group, the values of
its range in ``PARTS`` equal parts (a partial aggregate), and the group goes on
with the parts that hold the middle. Once a group's range holds few rows they
are sorted. ``rows_between`` cuts rows number ``first`` to ``last`` out of an ordered
table in the same way. State is a few numbers a group and pass, whatever the
rows or distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pumpwatch.session import ensure_checkpoint_dir
from pumpwatch.sources.tables import broadcast_few

#: Parts that a range is counted in.
PARTS = 256
#: Rows that are sorted in one place, at most.
FEW = 10_000


def _part(value: Column, low: Column, high: Column) -> Column:
    """Which part of low..high a value is in; rising with the value, so parts are ranges."""
    share = (value.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    return F.when(high <= low, F.lit(0)).otherwise(F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).cast("int")


def medians(df: DataFrame, keys: list[str], value: str, few: int | None = None) -> DataFrame:
    """(keys, median): the exact median of the finite numbers ``value`` of each group of ``keys``.

    A double, the mean of the two middle values of an even count; null values
    aren't counted, groups with nothing else have a null median. Null keys are
    groups as others are.
    """
    few = few or FEW
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    k = [F.col(f"`{c}`") for c in keys]
    rows = df.select(*k, F.col(f"`{value}`").alias("_v"))
    # the middle rows, counted from 0, are (n - 1) div 2 and n div 2
    state = rows.groupBy(*k).agg(F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")) \
        .select(*k, "_low", "_high", F.expr("(_n - 1) div 2").alias("_first"), F.expr("_n div 2").alias("_last"),
                F.col("_n").alias("_held")).checkpoint(eager=True)

    def in_range(state: DataFrame) -> DataFrame:
        s = state.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keys)], *[c for c in state.columns if c not in keys])
        on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(s[f"_{i}"]) for i, c in enumerate(keys)], F.lit(True)) \
            if keys else F.lit(True)
        return rows.join(broadcast_few(s), on).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))

    settled, few_left = [], []
    while True:
        equal = F.col("_low").isNull() | (F.col("_low") == F.col("_high"))
        settled.append(state.where(equal).select(*k, F.col("_low").alias("_x"), F.col("_low").alias("_y")))
        few_left.append(state.where(~equal & (F.col("_held") <= few)))
        state = state.where(~equal & (F.col("_held") > few))
        if state.isEmpty():
            break
        counted = (in_range(state).withColumn("_part", _part(F.col("_v"), F.col("_low"), F.col("_high")))
                   .groupBy(*k, "_part", "_first", "_last")
                   .agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")))
        parts = counted.groupBy(*k, "_first", "_last").agg(      # PARTS entries at most
            F.array_sort(F.collect_list(F.struct("_part", "n", "low", "high"))).alias("parts"))
        parts = parts.withColumn("upto", F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.aggregate(
            F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda a, p: a + p["n"])))
        at = lambda rank: F.element_at("parts", F.size(F.filter("upto", lambda u: u <= F.col(rank))) + 1)
        before = F.array_max(F.concat(F.array(F.lit(0).cast("long")), F.filter("upto", lambda u: u <= F.col("_first"))))
        parts = parts.select(*k, "_first", "_last", at("_first").alias("a"), at("_last").alias("b"), before.alias("before")) \
            .checkpoint(eager=True)
        # the middle is between two parts: the last row of one and the first of the next
        settled.append(parts.where("a._part < b._part").select(*k, F.col("a.high").alias("_x"), F.col("b.low").alias("_y")))
        state = parts.where("a._part = b._part").select(
            *k, F.col("a.low").alias("_low"), F.col("a.high").alias("_high"), (F.col("_first") - F.col("before")).alias("_first"),
            (F.col("_last") - F.col("before")).alias("_last"), F.col("a.n").alias("_held"))
    sort = in_range(reduce(DataFrame.unionByName, few_left)).groupBy(*k, "_first", "_last").agg(
        F.array_sort(F.collect_list("_v")).alias("_all"))
    middle = lambda i: F.element_at("_all", (F.col(i) + 1).cast("int"))
    settled.append(sort.select(*k, middle("_first").alias("_x"), middle("_last").alias("_y")))
    return reduce(DataFrame.unionByName, settled).select(
        *k, (0.5 * F.col("_x").cast("double") + 0.5 * F.col("_y").cast("double")).alias("median"))


# ------------------------------------------------------------------ pages
def _whole(x: int) -> Column:
    """A whole number of any size as a literal."""
    return F.lit(str(x)).cast("decimal(20,0)")


def _ordinal(column: str, kind: T.DataType, descending: bool) -> Column:
    """A whole number in the order of the column, nulls last; 38 digits, so that no negation overflows."""
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif not isinstance(kind, T.IntegralType):
        raise TypeError(f"{column}: only whole numbers and times can be searched")
    c = c.cast("decimal(20,0)")
    return F.coalesce(-c if descending else c, _whole(1 << 64))


class _Bounds:
    """Where the row of one rank is: fixed leading ordinals, a range of the next, rows before and in it."""

    def __init__(self, rank: int, total: int) -> None:
        self.rank, self.fixed, self.low, self.high, self.held = rank, [], None, None, total

    def condition(self) -> Column:
        c = reduce(lambda a, b: a & b, [F.col(f"_o{i}") == _whole(x) for i, x in enumerate(self.fixed)], F.lit(True))
        if self.low is not None:
            c = c & F.col(f"_o{len(self.fixed)}").between(*(_whole(x) for x in (self.low, self.high)))
        return c


def _narrow(rows: DataFrame, b: _Bounds, n_keys: int, few: int) -> None:
    """Narrow the range around row number ``rank`` until it holds ``few`` rows or only equal ones."""
    while b.held > few and len(b.fixed) < n_keys:
        o = F.col(f"_o{len(b.fixed)}")
        if b.low is None:
            low, high = rows.where(b.condition()).agg(F.min(o), F.max(o)).first()
            b.low, b.high = int(low), int(high)
        if b.low == b.high:
            b.fixed, b.low, b.high = [*b.fixed, b.low], None, None
            continue
        width = -(-(b.high - b.low + 1) // PARTS)
        part = F.floor((o - _whole(b.low)) / _whole(width)).cast("int")
        counts = sorted(rows.where(b.condition()).groupBy(part.alias("p")).count().collect())      # PARTS rows at most
        for p, n in counts:
            if b.rank < n:
                break
            b.rank -= n
        b.held, low = n, b.low + p * width
        b.low, b.high = low, min(b.high, low + width - 1)


def rows_between(df: DataFrame, order: list[tuple[str, bool]], first: int, last: int, total: int | None = None,
                 few: int | None = None) -> DataFrame:
    """Rows number ``first`` to ``last`` - 1 of ``df`` in ``order`` (column, descending), nulls last.

    No task holds the rows before them: the ranges that the first and the last row
    are in are found by counts, and only rows between are sorted, their number
    being the page and two times ``few`` at most. Rows equal in all columns of
    ``order`` have no order among them. ``total``: the number of rows, if known.
    """
    few = few or FEW
    kinds = dict(zip(df.columns, [f.dataType for f in df.schema.fields]))
    o = [f"_o{i}" for i in range(len(order))]
    rows = df.select("*", *[_ordinal(c, kinds[c], d).alias(x) for (c, d), x in zip(order, o)])
    total = rows.count() if total is None else total
    first, last = max(0, first), min(last, total)
    if first >= last:
        return df.limit(0)
    numbered = lambda part: part.select("*", F.row_number().over(Window.orderBy(*o)).alias("_rn"))
    if last <= few:
        return numbered(rows.orderBy(*o).limit(last)).where(F.col("_rn") > first).drop("_rn", *o)
    ends = []
    for rank in (first, last - 1):
        ends.append(_Bounds(rank, total))
        _narrow(rows, ends[-1], len(order), few)
    a, b = ends

    def beyond(bound: _Bounds, after: bool) -> Column:
        """Rows past the bound's range, in either direction, in the order of all ordinals."""
        out, equal = F.lit(False), F.lit(True)
        edges = [*bound.fixed] + ([bound.high if after else bound.low] if bound.low is not None else [])
        for i, x in enumerate(edges):
            x = _whole(x)
            out = out | (equal & (F.col(f"_o{i}") > x if after else F.col(f"_o{i}") < x))
            equal = equal & (F.col(f"_o{i}") == x)
        return out
    part = rows.where(~beyond(a, False) & ~beyond(b, True))
    size = last - first
    return numbered(part.orderBy(*o).limit(a.rank + size)).where(F.col("_rn") > a.rank).drop("_rn", *o)
