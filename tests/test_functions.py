from pyspark.sql import functions as F

from playledger import functions as V
from playledger.functions.values import safe_number


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_safe_numeric(spark):
    texts = ["-3.5x", "a12.b", "none", None, "7", "1.2.3"]
    assert one(spark, *[V.safe_numeric(F.lit(t)) for t in texts]) == (3.5, 12.0, 0.0, 0.0, 7.0, 1.2)
    assert one(spark, safe_number(F.lit(None).cast("int")), safe_number(F.lit(3))) == (0.0, 3.0)


def test_first_available(spark):
    nan, null = F.lit(float("nan")), F.lit(None).cast("double")
    assert one(spark, V.first_available(nan, null, F.lit(2.0), floats=True)) == (2.0,)
    assert one(spark, V.first_available(nan, null, default=9.0, floats=True)) == (9.0,)
    assert one(spark, V.first_available(F.lit(None).cast("string"), F.lit(""), default="d")) == ("",)


def test_half_even(spark):
    xs = [0.25, 0.35, 31.25, -0.25, 2.0]
    assert one(spark, *[V.half_even(F.lit(x)) for x in xs]) == (0.2, 0.4, 31.2, -0.2, 2.0)
    assert one(spark, V.whole(F.lit(2.5)), V.whole(F.lit(3.5))) == (2, 4)


def test_year_and_keys(spark):
    assert one(spark, *[V.year_of(F.lit(t)) for t in ("2020-01", "202", "", "abcd", None, "20.5")]) == (
        2020, 2023, 2023, 2023, 2023, 2023)
    assert one(spark, V.month_key(F.lit("2020-01-02T00")), V.date_key(F.lit("2020-01-02T00"))) == (
        "2020-01", "2020-01-02")
    parsed = [V.month_key_parsed(F.lit(t)) for t in ("2020-01-02", "2020-03-04T05:06:07Z", "x", "")]
    assert one(spark, *parsed) == ("2020-01", "2020-03", None, None)


def test_known_is_null_for_null(spark):
    assert one(spark, V.known(F.lit("N/A")), V.known(F.lit("ok")), V.known(F.lit(None).cast("string"))) == (
        False, True, None)


def test_first_timestamp(spark):
    df = spark.createDataFrame([(None, "b"), ("a", "c")], "endTime STRING, timestamp STRING")
    assert [r[0] for r in df.select(V.first_timestamp(df)).collect()] == ["b", "a"]
    assert V.first_timestamp(df.select(F.lit(1).alias("other"))) is None


def test_name_sample(spark):
    names = F.array(F.lit("b"), F.lit("a"))
    assert one(spark, V.name_sample(names, F.lit(2)), V.name_sample(names, F.lit(4))) == (
        "a, b", "a, b...")
