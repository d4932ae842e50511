"""Random inputs: Spark expressions equal the reference's Python rules."""

from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orderlens.functions import format as fmt

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

words = st.lists(st.text(alphabet=st.sampled_from(list("abcXYZé-_' 9#.ñ")), max_size=20), min_size=1, max_size=40)
amounts = st.lists(st.decimals(min_value=-10**9, max_value=10**9, places=2, allow_nan=False, allow_infinity=False),
                   min_size=1, max_size=40)


@SETTINGS
@given(words)
def test_title_case_equals_python_title(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(fmt.title_case("v")).collect()]
    assert got == [v.title() for v in values]


@SETTINGS
@given(amounts)
def test_currency_equals_python_format(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v decimal(18,2)")
    got = [r[0] for r in df.select(fmt.currency("v")).collect()]
    assert got == [f"₹{float(v):,.2f}" for v in values]


@SETTINGS
@given(words, st.integers(min_value=1, max_value=25))
def test_truncate_equals_python_slice(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(fmt.truncate("v", n)).collect()]
    assert got == [v[:n] + ("..." if len(v) > n else "") for v in values]

timestamps = st.lists(st.datetimes(min_value=datetime(1000, 1, 1), max_value=datetime(9999, 12, 31)),
                      min_size=1, max_size=40)


@SETTINGS
@given(timestamps)
def test_format_ntz_equals_python_strftime(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v timestamp_ntz")
    rows = df.select(fmt.datetime_text("v"), fmt.datetime_text("v", fmt.CHART_LABEL_FORMAT),
                     fmt.datetime_text("v", fmt.TIME_FORMAT)).collect()
    want = [(v.strftime("%d %b %Y, %I:%M %p"), v.strftime("%d %b %I:%M %p"), v.strftime("%I:%M %p")) for v in values]
    assert [tuple(r) for r in rows] == want
