"""Missing values, constants, ties, tiny tables: literal frames with known results."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dataloom.functions.columns import canonicalise, columns_of, require_columns, row_hash
from dataloom.functions.parsing import looks_numeric, parse_datetime, stripped
from dataloom.operators import charts, clean, features, preview, profile, validate
from dataloom.operators.process import process

NAN = float("nan")


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, x {kind}")


def one(df):
    return df.first().asDict()


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_nan_and_null_are_missing(spark):
    df = frame(spark, [1.0, NAN, None, 3.0])
    assert by_column(profile.missing_by_column(df))["x"]["missing"] == 2
    stats = by_column(profile.describe(df, ["x"]))["x"]
    assert (stats["count"], stats["mean"], stats["max"], stats["q50"]) == (2, 2.0, 3.0, 2.0)
    assert by_column(profile.distinct_by_column(df))["x"]["unique_values"] == 2


def test_negative_zero_equals_zero(spark):
    df = frame(spark, [0.0, -0.0])
    assert by_column(profile.distinct_by_column(df))["x"]["unique_values"] == 1
    assert one(profile.duplicate_count(df.select("x")))["duplicate_rows"] == 1


def test_all_missing_column(spark):
    df = frame(spark, [None, NAN])
    info = by_column(profile.column_info(df))["x"]
    assert (info["missing"], info["unique_values"], info["median"]) == (2, 0, None)
    assert by_column(profile.describe(df, ["x"]))["x"]["count"] == 0
    assert [r.x for r in clean.impute_median(df).collect()] == [None, None]


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    assert charts.correlation_pairs(df).first()["correlation"] is None
    matrix = {(r.feature_1, r.feature_2): r.correlation for r in charts.correlation_matrix(df).collect()}
    assert matrix[("a", "a")] == 1.0 and matrix[("c", "c")] is None and len(matrix) == 4
    scaled = features.scale_minmax(features.scale_standard(df.select("c"))).collect()
    assert {(r.c_scaled, r.c_normalized) for r in scaled} == {(0.0, 0.0)}
    assert validate.outliers_zscore(df, "c", 1.0).count() == 0
    assert [r.c for r in clean.clip_iqr(df).collect()] == [5.0] * 3
    assert one(charts.box_summary(df, "c"))["outliers"] == 0
    assert sum(r.n for r in charts.histogram(df, "c", 5).collect()) == 3


def test_one_row(spark):
    df = frame(spark, [4.0])
    stats = by_column(profile.describe(df, ["x"]))["x"]
    assert (stats["std"], stats["q25"], stats["q75"]) == (None, 4.0, 4.0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, t string")
    metrics = one(validate.quality_metrics(df))
    assert (metrics["missing_pct"], metrics["duplicate_pct"], metrics["quality_score"]) == (0, 0, 100)
    assert by_column(profile.column_info(df))["x"]["missing"] == 0
    assert one(profile.duplicate_count(df))["duplicate_rows"] == 0
    assert clean.clean(df).count() == 0
    assert one(validate.outlier_report(df, "x"))["outliers"] == 0
    assert charts.histogram(df, "x", 5).count() == 0


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, NAN, 4.0), (3.0, 7.0, None), (4.0, 8.0, 2.0), (5.5, 9.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = pd.DataFrame(rows, columns=list("abc")).astype(float).corr()
    for r in charts.correlation_matrix(df).collect():
        assert r.correlation == pytest.approx(want.loc[r.feature_1, r.feature_2])


def test_mode_takes_smallest_of_ties(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "a", "b", "c", "c", None]], "t string")
    assert [r.value for r in profile.value_counts(df, "t").collect()] == ["a", "b", "c"]
    assert [r.t for r in clean.impute_mode(df).filter("t is not null").collect()].count("a") == 3


def test_booleans(spark):
    df = spark.createDataFrame([(True, 1), (False, 2), (None, 3), (True, 4), (True, 5)], "b boolean, n int")
    assert set(by_column(profile.numeric_profile(df))) == {"b", "n"}
    assert columns_of(df, "numeric").columns == ["n"]
    assert [r.b for r in clean.impute_median(df).orderBy("n").collect()] == [1.0, 0.0, 1.0, 1.0, 1.0]


@pytest.mark.parametrize("rows", [5, 10, 11, 40])
def test_smoothed_curve_follows_the_rolling_mean(spark, rows):
    values = [float((i * 7) % rows) for i in range(rows)]
    window = rows // 10 if rows > 10 else rows
    want = pd.Series(sorted(values)).rolling(window, min_periods=1, center=True).mean()
    got = charts.smoothed_sorted(frame(spark, values), "x", ["id"]).orderBy("position").collect()
    assert [r.smoothed for r in got] == pytest.approx(list(want))


def test_smoothed_curve_with_missing_values(spark):
    values = [float(i % 9) if i % 4 else None for i in range(60)]
    series = pd.Series(values, dtype=float).sort_values().reset_index(drop=True)
    want = series.rolling(6, min_periods=1, center=True).mean()
    got = charts.smoothed_sorted(frame(spark, values), "x", ["id"]).orderBy("position").collect()
    assert [NAN if r.smoothed is None else r.smoothed for r in got] == pytest.approx(
        list(want), nan_ok=True
    )


def test_indicators_of_a_missing_category(spark):
    df = spark.createDataFrame([("a",), (None,), ("b b",)], "t string")
    assert features.one_hot_all(df).columns == ["t_a", "t_b b"]
    assert tuple(features.one_hot_all(df).collect()[1]) == (False, False)
    assert features.one_hot_low_card(df).columns == ["t", "t_b b"]
    with pytest.raises(ValueError):
        features.one_hot_all(df, max_categories=1)


@pytest.mark.parametrize("text,number", [
    ("1e3", True), (" 5 ", True), ("-.5", True), ("1d", False), ("NaN", False), ("0x1f", False),
    ("1_000", False), ("", False),
])
def test_number_texts(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(looks_numeric(F.col("t"))).first()[0] is number


def test_date_texts(spark):
    texts = ["2024-02-30", "2024-02-28", "2024-02-28 10:00:00", "28.02.2024", "2/3", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_datetime(F.col("t")).cast("string")).collect()]
    assert got == [None, "2024-02-28 00:00:00", "2024-02-28 10:00:00", "2024-02-28 00:00:00", None, None]


def test_dates_are_read_as_pandas_reads_them(spark):
    days = [
        "2024-01-05", "2024/1/5", "2024.01.05", "20240105", "1/5/2024", "5.1.2024", "05-01-2024", "13/1/2024", "31.12.2024",
        "Jan 5, 2024", "January 5 2024", "Sep 5, 2024", "5 Jan 2024", "5-Jan-2024", "05 December, 2024", "Fri, 5 Jan 2024",
        "Friday, January 5, 2024", "MAY 3rd, 2024", "3rd may 2024",
    ]
    clocks = ["", " 10:00", " 19:15:27", " 23:59:59.125", " 10:00 PM", " 12:30 am", " 12:30:15 PM", " 7PM"]
    zones = ["", "Z", " UTC", "+02:00", "-0530"]
    texts = [d + c for d in days for c in clocks]
    texts += [f"2024-01-05T10:11:12{z}" for z in zones] + [f"Jan 5, 2024 1:02 PM{z}" for z in ("", " UTC")]
    bad = [
        "2024-13-05", "2024-02-30", "31/31/2024", "0/5/2024", "Jun 31, 2024", "2024-01-05 25:00", "2024-01-05 13:00 PM",
        "2024-01-05 0:30 PM", "soon", "", "Januar 5, 2024", "12", "1234567", "20241301", "Jan", "5", "Marvellous day, 2024",
    ]
    df = spark.createDataFrame([(t,) for t in texts + bad], "t string")
    got = {r.t: r.m for r in df.select("t", parse_datetime(F.col("t")).alias("m")).collect()}
    for text in texts:
        want = pd.to_datetime(text, utc=True).tz_localize(None).to_pydatetime()
        assert got[text] == want, text
    assert {t: got[t] for t in bad} == dict.fromkeys(bad)


def test_type_suggestions_on_a_sample(spark):
    rows = [(i, "x" if i >= 100 else str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string")
    assert validate.type_suggestions(df).count() == 0
    assert validate.type_suggestions(df, 100, ["id"]).first()["suggested_type"] == "numeric"


def test_row_hash_tells_where_the_null_is(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert df.select(row_hash(df)).distinct().count() == 2


def test_row_aggregates_skip_missing(spark):
    df = spark.createDataFrame([(1, 2.0, None), (None, None, None), (4, None, None)],
                               "a int, b double, c double")
    rows = features.row_aggregates(df).collect()
    assert (rows[0].sum_numeric, rows[0].mean_numeric) == (3.0, 1.5)
    assert rows[0].std_numeric == pytest.approx(math.sqrt(0.5))
    assert (rows[1].sum_numeric, rows[1].mean_numeric, rows[1].std_numeric) == (0.0, None, None)
    assert rows[2].std_numeric is None
    assert features.row_aggregates(df.drop("c")).columns == ["a", "b"]


def test_ratio_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1, 0)], "a int, b int")
    assert features.pair_features(df).first()["a_b_ratio"] is None


def test_log_only_when_all_positive(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 0.0, None)], "a double, b double, c double")
    assert [c for c in features.transform(df).columns if c.endswith("_log")] == ["a_log"]


def test_formats(spark):
    def format_of(rows, schema):
        return one(profile.detect_format(spark.createDataFrame(rows, schema)))["format"]

    assert format_of([("x" * 200,)], "t string") == "text"
    assert format_of([("x",)], "t string") == "categorical"
    assert format_of([(1,)], "n int") == "numeric"
    assert format_of([(1, "x")], "n int, t string") == "mixed"
    assert format_of([(True,)], "b boolean") == "generic"
    assert format_of([(None, 1)], "d date, n int") == "time_series"


def test_nested_columns_are_profiled(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    info = by_column(profile.column_info(df))
    assert info["embedding"]["missing"] == 0 and info["embedding"]["unique_values"] > 1
    assert one(profile.dataset_info(df))["estimated_mb"] > 0


def test_column_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, None)], ["a.b c", "d`e"])
    assert by_column(profile.column_info(df))["a.b c"]["max"] == 2.0
    assert one(validate.outlier_report(df, "a.b c"))["outliers"] == 0
    assert charts.histogram(df, "a.b c", 5).count() == 5


def test_required_columns(spark):
    with pytest.raises(ValueError, match="target"):
        require_columns(spark.createDataFrame([("a",)], "input string"), ["input", "target"])


def test_preview_errors_and_process_errors(spark):
    df = frame(spark, [1.0])
    with pytest.raises(ValueError):
        preview.scatter_matrix(df, ["x"])
    with pytest.raises(ValueError):
        process(None, "Data Cleaning")
    with pytest.raises(ValueError):
        process(df, "Nothing")
    with pytest.raises(ValueError):
        preview.raw_records(df, ["id"], fmt="xml")


def test_sample_has_exactly_n_rows(spark):
    df = frame(spark, [float(i) for i in range(50)])
    assert preview.sample(df, ["id"], 20).distinct().count() == 20
    assert preview.sample(df, ["id"], 90).count() == 50


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("\t a b\n ",)], "t string")
    assert df.select(stripped(F.col("t"))).first()[0] == "a b"


def test_canonicalise_keeps_other_types(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet")
    assert canonicalise(df).schema.simpleString() == df.schema.simpleString()


def test_long_texts_in_profile_and_mode(spark):
    long_a, long_b = "a" * 100, "b" * 5_000
    values = [long_b] * 3 + [long_a] * 3 + ["short", None]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert by_column(profile.distinct_by_column(df))["t"]["unique_values"] == 3
    top = {r.value: r.n for r in profile.top_values(df).collect()}
    assert top == {long_a: 3, long_b: 3, "short": 1}
    filled = [r.t for r in clean.impute_mode(df).collect()]
    assert sorted(filled.count(v) for v in (long_a, long_b)) == [3, 4] and None not in filled


def test_kernel_density_has_mass_one(spark):
    df = spark.createDataFrame([("g", float(i % 37)) for i in range(400)], "g string, v double")
    for bins in (None, 256):
        rows = charts.violin(df, "v", "g", grid=200, bins=bins).orderBy("x").collect()
        step = rows[1].x - rows[0].x
        assert 0.85 < sum(r.density for r in rows) * step < 1.01


def test_maps_can_be_hashed(spark):
    df = spark.sql("select map('a', 1, 'b', 2) m union all select map('b', 2, 'a', 1)")
    assert df.select(row_hash(df)).distinct().count() == 1


def test_nested_nulls_count(spark):
    frames = [
        spark.createDataFrame([([None, 1],), ([1, None],), ([1],)], "x array<int>"),
        spark.createDataFrame([((None, 1),), ((1, None),)], "x struct<a: int, b: int>"),
        spark.createDataFrame([([(None, 1)],), ([(1, None)],)], "x array<struct<a: int, b: int>>"),
        spark.createDataFrame([({"k": None},), ({},), (None,)], "x map<string, int>"),
    ]
    for df in frames:
        assert profile.duplicate_count(df).first()[0] == 0


@pytest.mark.parametrize("kind, left, right", [
    ("array<map<string, int>>", "array(map('a', 1, 'b', 2))", "array(map('b', 2, 'a', 1))"),
    ("struct<m: map<string, array<double>>>", "named_struct('m', map('a', array(1D), 'b', array(double('NaN'))))",
     "named_struct('m', map('b', array(NULL), 'a', array(1D)))"),
    ("array<double>", "array(1D, double('NaN'), 0D)", "array(1D, NULL, -0D)"),
    ("array<array<float>>", "array(array(float('NaN')))", "array(array(float(NULL)))"),
    ("map<int, map<int, int>>", "map(1, map(1, 2, 3, 4), 2, NULL)", "map(2, NULL, 1, map(3, 4, 1, 2))"),
    ("struct<a: struct<x: double>>", "named_struct('a', named_struct('x', double('NaN')))", "named_struct('a', named_struct('x', NULL))"),
])
def test_equal_nested_values_are_equal_at_every_depth(spark, kind, left, right):
    cast = lambda v: f"select cast({v} as {kind}) x"
    df = spark.sql(f"{cast(left)} union all {cast(right)} union all {cast('NULL')} union all {cast('NULL')}")
    assert df.select(row_hash(df)).distinct().count() == 2
    assert profile.duplicate_count(df).first()[0] == 2
    assert profile.distinct_by_column(df).first()["unique_values"] == 1


def test_unread_dates_stop_the_series(spark):
    texts = ["2024-01-05T10:00:00.5", "2024-01-06T23:30:00-01:00", "1/7/2024", "2024-1-8", "1.9.2024 8:15 PM", None]
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, y int")
    days = [str(r.period) for r in charts.time_series(df, "t", "y", "day", "count").collect()]
    assert days == ["2024-01-05", "2024-01-07", "2024-01-08", "2024-01-09"]
    wrong = df.unionAll(spark.createDataFrame([("soon", 1)], df.schema))
    with pytest.raises(Exception, match="not a date in t: soon"):
        charts.time_series(wrong, "t", "y", "day", "count").collect()
    assert charts.time_series(wrong, "t", "y", "day", "count", unread="drop").count() == 4


def test_infinite_values_leave_the_smoothed_curve(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 4, 5])] + [(9, float("-inf"))], "k int, x double")
    rows = charts.smoothed_sorted(df, "x", ["k"]).collect()
    assert all(v == v for r in rows for v in r.asDict().values() if isinstance(v, float))


def test_ties_of_long_texts_go_to_the_smallest(spark):
    a, y = "A" * 100, "y" * 100
    df = spark.createDataFrame([(a,), (y,), (a,), (y,), ("z",), ("z",), (None,)], "t string")
    assert {r.t for r in clean.impute_mode(df).collect()} == {a, y, "z"}
    assert [r.value for r in profile.top_values(df, k=2).collect()] == [a, y]
    assert clean.impute_mode(df).where(f"t = '{a}'").count() == 3


def test_no_new_column_replaces_another(spark):
    df = spark.createDataFrame([("A", 1, 2.0), ("B", 2, 3.0), ("b", 3, 4.0)], "flag string, flag_B int, x double")
    got = features.one_hot_low_card(df)
    assert got.columns == ["flag", "flag_B", "x", "flag_B_2", "flag_b_3"]
    assert [tuple(r) for r in got.orderBy("x").collect()] == [("A", 1, 2.0, False, False), ("B", 2, 3.0, True, False), ("b", 3, 4.0, False, True)]
    assert features.one_hot_all(df).columns == ["flag_B", "x", "flag_A", "flag_B_2", "flag_b_3"]
    with pytest.raises(ValueError):
        features.one_hot_all(df, max_categories=2)
