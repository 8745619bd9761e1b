"""Pivot with row / column / grand totals (OP-09, AGG-11..14, FLT-12, TOP-10).

Totals aggregate the RAW records, not the cell values: one GROUPING SETS
aggregate computes cells (rows × cols), row totals (rows), column totals
(cols) and the grand total (()) in a single pass with map-side partial
aggregation. The wide table is a Spark ``pivot`` over the long result with an
explicit, bounded list of column labels.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwatch.functions.scalars import csv_field
from pumpwatch.operators.selection import medians
from pumpwatch.session import ensure_checkpoint_dir, work_dir

TOTALS = "Totals"
LABEL_SEP = " - "
BOM = "\ufeff"


def aggregator(name: str, value: str) -> Column:
    """AGG-14: the aggregators offered by the pivot menu, but for the exact median (``pivot_long``)."""
    v = F.col(f"`{value}`")
    table = {
        "count": F.count(F.lit(1)),
        "count_distinct": F.count_distinct(v),
        "sum": F.sum(v),
        "avg": F.avg(v),
        "median_approx": F.percentile_approx(v, 0.5, 10_000),
        "var_samp": F.var_samp(v),
        "stddev_samp": F.stddev_samp(v),
        "min": F.min(v),
        "max": F.max(v),
        # the pivot menu's First / Last take the first / last value in sort order
        "first": F.min(v),
        "last": F.max(v),
    }
    if name not in table:
        raise ValueError(f"unknown aggregator {name!r}; one of {sorted(table)}")
    return table[name]


def filter_values(df: DataFrame, include: dict | None = None,
                  exclude: dict | None = None) -> DataFrame:
    """FLT-12: keep only ticked values of an attribute / drop unticked ones."""
    for attr, values in (include or {}).items():
        df = df.where(F.col(f"`{attr}`").isin(list(values)))
    for attr, values in (exclude or {}).items():
        df = df.where(~F.col(f"`{attr}`").isin(list(values)) | F.col(f"`{attr}`").isNull())
    return df


def pivot_long(df: DataFrame, rows: list[str], cols: list[str], value: str = "Price",
               aggs: dict[str, str | tuple[str, str]] | None = None,
               include: dict | None = None,
               exclude: dict | None = None) -> DataFrame:
    """Cells and totals in long form.

    Output: row attrs, col attrs, one column per aggregator (default
    ``value`` = avg of ``value``; an entry may name its own input column as
    (aggregator, column)), ``is_total_row`` (all row attrs rolled up) and
    ``is_total_col`` (all col attrs rolled up). ``median`` is exact, for finite
    numbers, and found by counts of value ranges.
    """
    aggs = aggs or {"value": "avg"}
    df = filter_values(df, include, exclude)
    sets, seen = [], set()
    for s in (rows + cols, rows, cols, []):
        if tuple(s) not in seen:
            seen.add(tuple(s))
            sets.append([F.col(f"`{c}`") for c in s])
    keys = [F.col(f"`{c}`") for c in rows + cols]
    named = {out: (fn, value) if isinstance(fn, str) else fn for out, fn in aggs.items()}
    exprs = [aggregator(*fn).alias(out) for out, fn in named.items() if fn[0] != "median"]
    if any(fn == "median" for fn, _ in named.values()):
        df = _written(df, list(dict.fromkeys([*rows, *cols, *[of for fn, of in named.values() if fn != "count"]])))
    marks = []
    if rows:
        marks.append((F.grouping(F.col(f"`{rows[0]}`")) == 1).alias("is_total_row"))
    if cols:
        marks.append((F.grouping(F.col(f"`{cols[0]}`")) == 1).alias("is_total_col"))
    marks.append(F.grouping_id().alias("_set") if keys else F.lit(0).alias("_set"))
    g = df.groupingSets(sets, *keys).agg(*exprs, *marks) if keys else df.agg(*exprs, F.count(F.lit(1)).alias("_n"))
    if not rows:
        g = g.withColumn("is_total_row", F.lit(True))
    if not cols:
        g = g.withColumn("is_total_col", F.lit(True))
    for out, (fn, of) in named.items():
        if fn == "median":
            g = _with_median(g, df, rows + cols, seen, of, out)
    return g.select(*keys, *[F.col(f"`{out}`") for out in aggs], "is_total_row", "is_total_col")


def _written(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df``, written once to the shared folder: a median takes several passes over its rows."""
    path = work_dir(df.sparkSession, "pivot")
    kept = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    kept.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(kept.schema).parquet(path).toDF(*columns)


def _with_median(g: DataFrame, df: DataFrame, keys: list[str], sets: set[tuple], value: str, out: str) -> DataFrame:
    """The median of every line of the grouping sets: each row counts once in each set."""
    if not keys:
        return g.withColumn(out, medians(df, [], value).select("median").scalar())
    # as grouping_id: one bit for each key, set where the key is rolled up
    lines = [F.struct(*[(F.col(f"`{c}`") if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in keys],
                      F.lit(int("".join("0" if c in s else "1" for c in keys), 2)).cast("long").alias("_set")) for s in sorted(sets)]
    rows = df.select(F.explode(F.array(*lines)).alias("_line"), F.col(f"`{value}`").alias("_value")).select("_line.*", "_value")
    found = medians(rows, [*keys, "_set"], "_value")
    found = found.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate([*keys, "_set"])], F.col("median").alias(out))
    on = reduce(and_, [g[f"`{c}`"].eqNullSafe(found[f"_k{i}"]) for i, c in enumerate([*keys, "_set"])])
    return g.join(found, on, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def pivot_shares(df: DataFrame, rows: list[str], cols: list[str], value: str = "Price", agg: str = "sum",
                 include: dict | None = None, exclude: dict | None = None) -> DataFrame:
    """AGG-14, shares of totals: the long pivot with what part each line is of its totals.

    ``of_row`` is the line's value over that of all columns of its row, ``of_col``
    over that of all rows of its column, ``of_total`` over the grand total; null
    where that is 0 or null. Missing attributes are values like others. All totals
    come out of the one grouping-sets result, which is materialised once.
    """
    long = pivot_long(df, rows, cols, value, {"value": agg}, include, exclude)
    ensure_checkpoint_dir(long.sparkSession)
    long = long.checkpoint(eager=True)
    number = F.col("value").cast("double")

    def with_total(lines: DataFrame, keys: list[str], mark: str, rolled: str, name: str) -> DataFrame:
        totals = long.where(F.col(rolled)).select(
            *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)], F.col(mark).alias("_m"), number.alias(name))
        on = reduce(and_, [lines[f"`{c}`"].eqNullSafe(totals[f"_k{i}"]) for i, c in enumerate(keys)], lines[mark] == totals["_m"])
        return lines.join(totals, on, "left").drop("_m", *[f"_k{i}" for i in range(len(keys))])

    grand = long.where("is_total_row AND is_total_col").select(number).scalar()
    lines = with_total(long, rows, "is_total_row", "is_total_col", "_row")
    lines = with_total(lines, cols, "is_total_col", "is_total_row", "_col")
    part = lambda total: F.try_divide(number, total)
    return lines.select(*[F.col(f"`{c}`") for c in rows + cols], "value", part(F.col("_row")).alias("of_row"),
                        part(F.col("_col")).alias("of_col"), part(grand).alias("of_total"), "is_total_row", "is_total_col")


def column_keys(long: DataFrame, cols: list[str]) -> list[tuple]:
    """The column tuples of a long pivot in key order: the columns of the wide table.

    They come to the driver because a plan's columns are made there; a pivot of
    any width has the long form.
    """
    if not cols:
        return []
    names = [F.col(f"`{c}`") for c in cols]
    return [tuple(r) for r in long.where(~F.col("is_total_col")).select(*names).distinct()
            .orderBy(*[c.asc_nulls_last() for c in names]).collect()]


def label(key: tuple) -> str:
    """Leaf column label: the levels joined with ' - ', a missing one blank."""
    return LABEL_SEP.join("" if v is None else str(v) for v in key)


def pivot_table(df: DataFrame, rows: list[str], cols: list[str], value: str = "Price",
                agg: str = "avg", include: dict | None = None, exclude: dict | None = None,
                keys: list[tuple] | None = None) -> tuple[DataFrame, list[str]]:
    """Wide pivot: row attrs, ``is_total_row``, then one column c0, c1, … for each column
    tuple and ``total``; plus the totals row (``is_total_row`` = true).

    Returns (table, labels of c0, c1, …). Columns are told apart by their tuples,
    so tuples with equal labels, blanks and values named like the totals all
    have columns of their own. ``keys``: the tuples to show, in order.
    """
    long = pivot_long(df, rows, cols, value, {"value": agg}, include, exclude)
    if keys is None and cols:
        # cells and totals are materialised once: keys and cells are read from the copy
        ensure_checkpoint_dir(long.sparkSession)
        long = long.checkpoint(eager=True)
        keys = column_keys(long, cols)
    keys = keys or []

    number = F.when(F.col("is_total_col"), F.lit(len(keys)))
    if keys:
        pairs = F.create_map(*[x for i, k in enumerate(keys) for x in (
            F.to_json(F.array(*[F.lit(None if v is None else str(v)) for v in k])), F.lit(i))])
        own = F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in cols]))
        number = number.otherwise(F.try_element_at(pairs, own))
    wide = (long.withColumn("_n", number)
            .groupBy(*[F.col(f"`{r}`") for r in rows], "is_total_row")
            .pivot("_n", list(range(len(keys) + 1))).agg(F.first("value")))
    names = [f"c{i}" for i in range(len(keys))] + ["total"]
    wide = wide.select(*[F.col(f"`{r}`") for r in rows], "is_total_row",
                       *[F.col(f"`{i}`").alias(n) for i, n in enumerate(names)])
    return wide, [label(k) for k in keys]


def number_text(col: Column, agg: str = "avg") -> Column:
    """Cell text as the pivot renders it: 2 decimals with thousands separators."""
    if agg in ("count", "count_distinct"):
        return F.format_number(col.cast("double"), 0)
    return F.format_number(col.cast("double"), 2)


def pivot_csv_lines(df: DataFrame, rows: list[str], cols: list[str], value: str = "Price",
                    agg: str = "avg", order_by_totals: bool = False, **kw) -> DataFrame:
    """SNK-03: the pivot as CSV lines (section, sort keys, line).

    Header: row attribute names, leaf labels, 'Totals' (BOM-prefixed). Data
    lines: quoted row values, formatted cells ('' when empty), row total.
    Totals line: 'Totals' then '' for the other row attributes — every line
    has the header's width. ``section`` (0 header, 1 data, 2 totals) and the
    row keys give the file order (TOP-10: by key, or by the Totals value).
    """
    wide, labels = pivot_table(df, rows, cols, value, agg, **kw)
    spark = df.sparkSession
    header = BOM + ",".join(_quote(h) for h in rows + labels + [TOTALS])
    cells = [F.coalesce(number_text(F.col(c), agg), F.lit(""))
             for c in [*(f"c{i}" for i in range(len(labels))), "total"]]
    if rows:
        row_cells = [F.when(F.col("is_total_row") & F.lit(i == 0), F.lit(TOTALS))
                     .when(F.col("is_total_row"), F.lit(""))
                     .otherwise(F.coalesce(F.col(f"`{r}`").cast("string"), F.lit("")))
                     for i, r in enumerate(rows)]
    else:
        row_cells = []
    line = F.concat_ws(",", *[csv_field(c) for c in row_cells + cells])
    key_text = F.concat_ws("\u0000", *[F.coalesce(F.col(f"`{r}`").cast("string"), F.lit(""))
                                       for r in rows])
    by_value = (F.col("total").cast("double") if order_by_totals
                else F.lit(None).cast("double"))
    body = wide.select(F.when(F.col("is_total_row"), F.lit(2)).otherwise(F.lit(1)).alias("section"),
                       by_value.alias("sort_value"), key_text.alias("sort_key"),
                       line.alias("line"))
    head = spark.createDataFrame([(0, None, "", header)],
                                 "section int, sort_value double, sort_key string, line string")
    return head.unionByName(body)


def write_pivot_csv(lines: DataFrame, path: str) -> str:
    """Write one CSV file with CRLF line ends (pivots are small by construction:
    their size is bounded by the snapshot-selection guard)."""
    (lines.orderBy("section", F.col("sort_value").desc_nulls_last(), "sort_key")
     .select("line").coalesce(1)
     .write.mode("overwrite").option("lineSep", "\r\n").text(path))
    return path


def _quote(text: str) -> str:
    return '"' + " ".join(text.strip().splitlines()).replace('"', '""') + '"'
