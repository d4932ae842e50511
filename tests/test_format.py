from datetime import datetime

from pyspark.sql import functions as F

from orderlens.functions import format as fmt


def one(spark, expr, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_currency_edges(spark):
    df = spark.createDataFrame([(None,), ("abc",), ("-5",), ("1234567.125",), ("0.5",)], "v string")
    got = [r[0] for r in df.select(fmt.currency("v")).collect()]
    assert got == ["₹0.00", "₹0.00", "₹-5.00", "₹1,234,567.12", "₹0.50"]


def test_truncate_20_and_21(spark):
    df = spark.createDataFrame([("a" * 20,), ("b" * 21,), (None,)], "v string")
    got = [r[0] for r in df.select(fmt.truncate("v", 20)).collect()]
    assert got == ["a" * 20, "b" * 20 + "...", None]


def test_title_case_matches_python(spark):
    words = ["pending", "out-for-delivery", "UNITED KINGDOM", "o'neil x2y", "état_civil"]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [r[0] for r in df.select(fmt.title_case("v")).collect()]
    assert got == [w.title() for w in words]


def test_badges_and_colors(spark):
    df = spark.createDataFrame([("Pending",), ("refunded",), ("weird",), (None,)], "v string")
    rows = df.select(fmt.status_badge("v"), fmt.payment_badge("v"), fmt.status_color("v")).collect()
    assert [tuple(r) for r in rows] == [
        ("warning", "warning", "#ffc107"), ("secondary", "secondary", "#6c757d"),
        ("secondary", "secondary", "#6c757d"), ("secondary", "secondary", "#6c757d")]


def test_datetime_text_and_ist(spark):
    ts = datetime(2001, 7, 31, 13, 5, 0)
    df = spark.createDataFrame([(ts,), (None,)], "v timestamp_ntz")
    rows = df.select(fmt.datetime_text("v"), fmt.datetime_text("v", convert=True),
                     fmt.datetime_text_or_na("v")).collect()
    assert tuple(rows[0]) == ("31 Jul 2001, 01:05 PM", "31 Jul 2001, 06:35 PM", "31 Jul 2001, 06:35 PM")
    assert tuple(rows[1]) == ("", "", "N/A")


def test_datetime_text_comes_from_the_parts_of_the_value(spark):
    df = spark.createDataFrame([("0999-01-02 00:03:04.5",), ("1582-10-10 12:59:59",), ("9999-12-31 23:00:00",)], "s string")
    df = df.select(F.col("s").cast("timestamp_ntz").alias("v")).localCheckpoint()
    made = df.select(fmt.format_ntz("v", "yyyy MM MMM dd HH hh mm ss a").alias("t"))
    assert [r[0] for r in made.collect()] == ["0999 01 Jan 02 00 12 03 04 AM", "1582 10 Oct 10 12 12 59 59 PM", "9999 12 Dec 31 23 11 00 00 PM"]
    p = made._jdf.queryExecution().executedPlan().toString()
    assert "hour(v" in p and "dayofmonth(" in p


def test_years_beyond_four_digits_keep_their_text_form(spark):
    df = spark.range(1).select(F.timestamp_add("YEAR", F.lit(9000), F.lit("2001-07-31 13:05:06").cast("timestamp_ntz")).alias("v"))
    row = df.select(fmt.format_ntz("v", "yyyy ss"), F.concat(F.substring(F.col("v").cast("string"), 1, 4), F.lit(" "),
                                                             F.substring(F.col("v").cast("string"), 18, 2))).first()
    assert row[0] == row[1] == "+110 5:"


def test_datetime_from_text(spark):
    df = spark.createDataFrame([("2001-07-31 13:05:00",), ("garbage",), (None,)], "v string")
    got = [r[0] for r in df.select(fmt.datetime_text_from_string("v")).collect()]
    assert got == ["31 Jul 2001, 01:05 PM", "garbage", ""]


def test_map_link_image_location_signature(spark):
    df = spark.createDataFrame([(12, -3, "http://a/b.png", "Pune", "MH", "s" * 40),
                                (0, 5, "local.png", None, None, None)],
                               "lat int, lon int, url string, city string, state string, sig string")
    rows = df.select(fmt.map_link("lat", "lon"), fmt.image_url("url"), fmt.location_text("city", "state"),
                     fmt.signature_mask("sig")).collect()
    assert tuple(rows[0]) == ("https://www.google.com/maps?q=12,-3", "http://a/b.png", "Pune, MH", "s" * 30 + "...")
    assert tuple(rows[1]) == (None, fmt.DEFAULT_IMAGE, "N/A", None)


def test_formatting_ignores_session_zone_in_dst_gap(spark):
    """02:43 on 6 Apr 1997 does not exist in Los Angeles; a naive wall time
    must still print as written whatever the session zone is."""
    df = spark.createDataFrame([("1997-04-06 02:43:39",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("v"))
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        row = df.select(fmt.datetime_text("v"), fmt.datetime_text("v", fmt.TIME_FORMAT),
                        fmt.format_ntz("v", "yyyy-MM-dd HH:mm:ss")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert tuple(row) == ("06 Apr 1997, 02:43 AM", "02:43 AM", "1997-04-06 02:43:39")


def test_browser_datetime_text(spark):
    df = spark.createDataFrame([("2001-07-31T13:05:00",), ("2001-07-31 13:05",), ("soon",), ("",), (None,)], "v string")
    got = [r[0] for r in df.select(fmt.browser_datetime_text("v")).collect()]
    assert got == ["31 Jul 2001, 06:35 PM", "31 Jul 2001, 06:35 PM", "soon", "N/A", "N/A"]
