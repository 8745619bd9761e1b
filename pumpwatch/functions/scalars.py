"""Scalar Column expressions (SCL-01 … SCL-20).

All built-in functions, so they stay inside whole-stage codegen. Spark 4 runs
in ANSI mode: every parse that may fail uses a ``try_*`` form and yields NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pumpwatch.model import PRICE_TYPE

# fixed values: label for a missing region, missing-value mark, cent sign
NA_REGION = "N/A"
MISSING_MARK = "—"
CENT = "¢"
NBSP = "\u00a0"

# fixed values: accepted date-time parameter formats, tried in this order
DATETIME_FORMATS = ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")

# fixed values: display format of a snapshot time (minute precision, UTC)
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"


def blank_to_null(col: Column) -> Column:
    return F.when(col == F.lit(""), F.lit(None)).otherwise(col)


def region_label(col: Column) -> Column:
    """SCL-04: NULL and '' regions are both shown as 'N/A'."""
    return F.coalesce(blank_to_null(col), F.lit(NA_REGION))


def address_street(col: Column) -> Column:
    """SCL-01: text before the LAST comma (whole text when there is none), trimmed."""
    addr = F.coalesce(col, F.lit(""))
    return F.trim(F.when(F.instr(addr, ",") > 0, F.regexp_extract(addr, r"^(.*),", 1))
                  .otherwise(addr))


def address_city(col: Column) -> Column:
    """SCL-01: text after the last comma, trimmed; '' when there is no comma."""
    addr = F.coalesce(col, F.lit(""))
    return F.trim(F.regexp_extract(addr, r",([^,]*)$", 1))


def parse_price_text(col: Column) -> Column:
    """SCL-02: '199.9¢' / '1 999.9' → DECIMAL(10,2); unparsable → NULL.

    NBSP and the cent sign are removed, the rest trimmed and cast straight to
    DECIMAL(10,2) (HALF_UP to 2 places); 'nan'/'inf'/'' become NULL.
    """
    cleaned = F.trim(F.translate(col.cast("string"), NBSP + CENT, ""))
    return cleaned.try_cast(PRICE_TYPE)


def clean_fuel_name(col: Column) -> Column:
    """SCL-03: trimmed fuel name; NULL when empty after trimming."""
    return blank_to_null(F.trim(col))


def parse_datetime(col: Column) -> Column:
    """SCL-11: first matching format wins; bad or empty text → NULL (UTC)."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in DATETIME_FORMATS])


def parse_iso_timestamp(col: Column) -> Column:
    """SCL-12: ISO-8601 with optional offset; a naive value is UTC (session TZ)."""
    return col.try_cast("timestamp")


def minute_text(col: Column) -> Column:
    """SCL-14: snapshot time shown at minute precision."""
    return F.date_format(col, MINUTE_FORMAT)


def cents(col: Column, signed: bool = False) -> Column:
    """SCL-06: '%.1f¢' (or '%+.1f¢'); NULL → '—'. format_string needs a double."""
    fmt = ("%+.1f" if signed else "%.1f") + CENT
    # format_string turns NULL into text ("null" cut to "n"), so test first
    return F.when(col.isNull(), F.lit(MISSING_MARK)).otherwise(
        F.format_string(fmt, col.cast("double")))


def fit_left(col: Column, width: int) -> Column:
    """SCL-05: ``f"{x[:width-1]:<width}"`` — cut, then pad on the right."""
    return F.rpad(F.substring(F.coalesce(col, F.lit("")), 1, width - 1), width, " ")


def pad_right_aligned(col: Column, width: int) -> Column:
    """SCL-05: ``f"{x:>width}"`` — left padding, never cut."""
    s = F.coalesce(col, F.lit(""))
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, " "))


def coordinates_text(lat: Column, lon: Column) -> Column:
    """SCL-07: 'lat, lon' with 4 decimals."""
    return F.format_string("%.4f, %.4f", lat.cast("double"), lon.cast("double"))


def csv_field(col: Column) -> Column:
    """SCL-08: quoted CSV field — newlines → space, trimmed, '"' doubled."""
    s = F.trim(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"\r\n|\r|\n", " "))
    return F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))


def ceil_div(a: Column, b: Column) -> Column:
    """SCL-10: ceil(a / b) on integers."""
    return F.ceil(a.cast("double") / b.cast("double")).cast("long")


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(x, hi))


def next_boundary(ts: Column, minutes: int) -> Column:
    """SCL-15: first time at or after the minute of ``ts`` whose minute of the hour is a
    multiple of ``minutes``, counted on past the hour's end."""
    to_go = F.pmod(-F.minute(ts), F.lit(minutes))
    return F.date_trunc("minute", ts) + F.make_dt_interval(mins=to_go)


def add_minutes(ts: Column, minutes: Column) -> Column:
    """SCL-15: timestamp + N minutes (negative N subtracts)."""
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def pad_left_aligned(col: Column, width: int) -> Column:
    """SCL-05: ``f"{x:<width}"`` — right padding, never cut."""
    s = F.coalesce(col, F.lit(""))
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, " "))
