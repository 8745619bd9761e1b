"""Pivot CSV export against the golden lines of the reference's own pivot test
(T1, T2, T4 header/data rows; the totals row of multi-attribute pivots is
rectangular here — a documented deviation)."""

from decimal import Decimal

from pyspark.sql import functions as F

from pumpwatch.operators import pivot as pv

SCHEMA = "Station string, City string, Region string, Fuel string, Price decimal(10,2), Snapshot string"


def lines_of(spark, rows, rows_attrs, col_attrs):
    df = spark.createDataFrame(rows, SCHEMA)
    out = pv.pivot_csv_lines(df, rows_attrs, col_attrs)
    ordered = out.orderBy("section", F.col("sort_value").desc_nulls_last(), "sort_key")
    return [r.line for r in ordered.collect()]


# fixed values: records and expected lines of T1, T2 and T4
def test_t1_single_column_axis(spark):
    recs = []
    for snap in ("2026-04-11 02:20", "2026-04-11 02:31"):
        for fuel, price in (("Diesel", "265.90"), ("Régulier", "196.90"), ("Super", "221.90")):
            recs.append(("S", "C", "R", fuel, Decimal(price), snap))
    lines = lines_of(spark, recs, ["Snapshot"], ["Fuel"])
    assert lines[0] == '\ufeff"Snapshot","Diesel","Régulier","Super","Totals"'
    assert lines[1] == '"2026-04-11 02:20","265.90","196.90","221.90","228.23"'
    assert lines[2] == '"2026-04-11 02:31","265.90","196.90","221.90","228.23"'
    assert lines[3] == '"Totals","265.90","196.90","221.90","228.23"'
    assert len(lines) == 4


def test_t2_no_column_axis(spark):
    recs = [("Dépanneur Sprint", "L'Islet", "R", "Diesel", Decimal("221.00"), "2026-04-11 02:20")]
    lines = lines_of(spark, recs, ["Station", "City"], [])
    assert lines[0] == '\ufeff"Station","City","Totals"'
    assert lines[1] == '"Dépanneur Sprint","L\'Islet","221.00"'
    assert lines[2] == '"Totals","","221.00"'


def test_t4_two_column_axes(spark):
    recs = [("9405 Quebec Inc.", "Alma", "Abitibi", "Diesel", Decimal("259.90"), "t"),
            ("9405 Quebec Inc.", "Alma", "Abitibi", "Régulier", Decimal("194.40"), "t"),
            ("9405 Quebec Inc.", "Alma", "Estrie", "Diesel", Decimal("222.00"), "t")]
    lines = lines_of(spark, recs, ["City", "Station"], ["Region", "Fuel"])
    assert lines[0] == ('\ufeff"City","Station","Abitibi - Diesel","Abitibi - Régulier",'
                        '"Estrie - Diesel","Totals"')
    assert lines[1] == '"Alma","9405 Quebec Inc.","259.90","194.40","222.00","225.43"'
    assert lines[2] == '"Totals","","259.90","194.40","222.00","225.43"'
    assert len(lines) == 3


def test_totals_use_raw_records_not_cell_means(spark):
    # cell A has 3 records, cell B one: the total is the mean of 4 records
    recs = [("s", "c", "r", "A", Decimal(p), "t") for p in ("100.00", "100.00", "100.00")]
    recs.append(("s", "c", "r", "B", Decimal("200.00"), "t"))
    df = spark.createDataFrame(recs, SCHEMA)
    long = pv.pivot_long(df, ["Snapshot"], ["Fuel"])
    grand = long.where("is_total_row and is_total_col").collect()[0]
    assert float(grand.value) == 125.0  # not (100 + 200) / 2


def test_quoting_and_missing_cells(spark):
    recs = [('Le "Coin"', "Ville\nNord", "R", "A", Decimal("1234.5"), "t"),
            ("Autre", "X", "R", "B", Decimal("1.00"), "t")]
    lines = lines_of(spark, recs, ["Station"], ["Fuel"])
    assert lines[1] == '"Autre","","1.00","1.00"'
    assert lines[2] == '"Le ""Coin""","1,234.50","","1,234.50"'


def test_write_crlf_file(spark, tmp_path):
    recs = [("S", "C", "R", "Diesel", Decimal("1.00"), "t")]
    df = spark.createDataFrame(recs, SCHEMA)
    out = pv.write_pivot_csv(pv.pivot_csv_lines(df, ["Station"], ["Fuel"]), str(tmp_path / "p"))
    part = [p for p in (tmp_path / "p").iterdir() if p.name.startswith("part-")][0]
    raw = part.read_bytes()
    assert raw.startswith("\ufeff".encode())
    assert b"\r\n" in raw and out


def test_equal_labels_blanks_and_totals_are_columns_of_their_own(spark):
    recs = [("s", "c", "x - y", "z", Decimal("1.00"), "t"), ("s", "c", "x", "y - z", Decimal("2.00"), "t"),
            ("s", "c", None, "z", Decimal("3.00"), "t"), ("s", "c", "", "z", Decimal("4.00"), "t"),
            ("s", "c", "Totals", "z", Decimal("5.00"), "t")]
    lines = lines_of(spark, recs, ["City"], ["Region", "Fuel"])
    assert lines[0] == '\ufeff"City","- z","Totals - z","x - y - z","x - y - z","- z","Totals"'
    assert lines[1] == '"c","4.00","5.00","2.00","1.00","3.00","3.00"'


def test_rows_in_order_of_their_totals(spark):
    recs = [("s", c, "r", "A", Decimal(p), "t") for c, p in (("a", "1.00"), ("b", "3.00"), ("c", "2.00"))]
    out = pv.pivot_csv_lines(spark.createDataFrame(recs, SCHEMA), ["City"], ["Fuel"], order_by_totals=True)
    ordered = out.where("section = 1").orderBy(F.col("sort_value").desc_nulls_last(), "sort_key")
    assert [r.sort_key for r in ordered.collect()] == ["b", "c", "a"]
