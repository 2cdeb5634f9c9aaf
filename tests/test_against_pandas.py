"""The same steps in pandas, on one untidy table."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.operators import charts, features, missing, outliers, profile, scaling, text
from tabwright.sources.readers import read_csv


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(11)
    rows = []
    for i in range(700):
        rows.append(
            {
                "id": i,
                "x": None if rng.random() < 0.1 else round(rng.gauss(50, 20), 3),
                "y": None if rng.random() < 0.3 else round(rng.expovariate(0.1), 4),
                "n": rng.randrange(12),
                "s": rng.choice(["red", "blue", " green", None, "Äpfel", "zoo"]),
                "flag": rng.random() < 0.4,
            }
        )
    return pd.DataFrame(rows)


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "id int, x double, y double, n int, s string, flag boolean").repartition(5)


def ordered(df):
    return df.orderBy("id").toPandas()


def same(got, want):
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), rtol=1e-9, atol=1e-9)


@settings(max_examples=300, deadline=None)
@given(
    st.floats(-1e6, 1e6, allow_nan=False),
    st.floats(1e-4, 1e6, allow_nan=False),
    st.integers(2, 10),
)
def test_bin_labels_are_those_of_cut(low, width, bins):
    values = [low, low + width]
    want = pd.cut(pd.Series(values), bins=bins, include_lowest=True)
    edges = features.bin_edges(values[0], values[1], bins)
    assert features.bin_labels(edges) == [str(c) for c in want.cat.categories]


@pytest.mark.parametrize("value", [3.0, 0.0, -7.25, 1e-5])
def test_bin_labels_of_one_value(value):
    want = pd.cut(pd.Series([value]), bins=3, include_lowest=True)
    assert features.bin_labels(features.bin_edges(value, value, 3)) == [str(c) for c in want.cat.categories]


@pytest.mark.parametrize("bins", [2, 4, 7])
def test_binning(frame, df, bins):
    want = pd.cut(frame["x"], bins=bins, include_lowest=True).astype(str)
    assert list(ordered(features.binning(df, "x", bins, na_label="nan"))["x_binned"]) == list(want)


def test_describe(frame, df):
    want = frame.describe(include="all").T
    got = profile.describe_all(df).toPandas().set_index("column")
    for c in ("id", "x", "y", "n"):
        for ours, theirs in zip(("count", "mean", "std", "min", "q1", "median", "q3", "max"), want.columns[[0, 4, 5, 6, 7, 8, 9, 10]]):
            assert got.loc[c, ours] == pytest.approx(want.loc[c, theirs])
    for c in ("s", "flag"):
        assert got.loc[c, ["count", "unique", "freq"]].tolist() == want.loc[c, ["count", "unique", "freq"]].tolist()
        assert got.loc[c, "top"] == str(frame[c].mode().iloc[0]).replace("False", "false")


def test_correlation(frame, df):
    want = frame[["id", "x", "y", "n"]].corr().round(2)
    got = profile.correlation_wide(df).toPandas().set_index("column").loc[want.index, want.columns]
    same(got, want)


@pytest.mark.parametrize("method", ["ffill", "bfill"])
def test_fills_in_order(frame, df, method):
    step = missing.forward_fill if method == "ffill" else missing.backward_fill
    got = ordered(step(df, ["x", "s"], ["id"], ranges=25))
    same(got[["x"]], getattr(frame[["x"]], method)())
    assert got["s"].tolist() == getattr(frame["s"], method)().tolist()


def test_imputation(frame, df):
    got = ordered(missing.impute_all(df))
    same(got[["x", "y"]], frame[["x", "y"]].fillna(frame[["x", "y"]].median()))
    assert got["s"].tolist() == frame["s"].fillna(frame["s"].mode().iloc[0]).tolist()


def test_outliers(frame, df):
    numbers = frame[["id", "x", "y", "n"]]
    q1, q3 = numbers.quantile(0.25), numbers.quantile(0.75)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    same(ordered(outliers.iqr_cap(df))[numbers.columns], numbers.clip(low, high, axis=1))
    kept = frame[(numbers.isna() | ((numbers >= low) & (numbers <= high))).all(axis=1)]
    assert ordered(outliers.iqr_remove(df))["id"].tolist() == kept["id"].tolist()
    z = (numbers - numbers.mean()) / numbers.std()
    kept = frame[(z.isna() | (z.abs() <= 2)).all(axis=1)]
    assert ordered(outliers.zscore_remove(df, threshold=2))["id"].tolist() == kept["id"].tolist()
    cut = numbers["y"].clip(numbers["y"].quantile(0.03), numbers["y"].quantile(0.97))
    same(ordered(outliers.percentile_cap(df, ["y"], 3))[["y"]], cut.to_frame())


@pytest.mark.parametrize("drop_first", [False, True])
def test_dummies_and_codes(frame, df, drop_first):
    want = pd.get_dummies(frame, columns=["s"], drop_first=drop_first)
    got = ordered(scaling.one_hot(df, drop_first=drop_first))
    assert list(got.columns) == list(want.columns)
    for c in want.columns[5:]:
        assert got[c].tolist() == want[c].tolist()
    codes = frame["s"].astype("category").cat.codes
    assert ordered(scaling.label_encode(df))["s"].tolist() == codes.tolist()


def test_histogram(frame, df):
    want, edges = np.histogram(frame["y"].dropna(), bins=20)
    got = charts.histogram(df, "y").orderBy("bin").toPandas()
    assert got["count"].tolist() == want.tolist()
    np.testing.assert_allclose(got["low"], edges[:-1], atol=1e-9)


def test_value_counts(frame, df):
    want = frame["n"].value_counts(dropna=False)
    got = text.value_counts(df, "n").toPandas()
    assert dict(zip(got["value"], got["count"])) == want.to_dict()


def test_features(frame, df):
    x = frame["x"] - 50
    got = df.withColumn("x", F.col("x") - 50)
    for step, want in (
        (features.log, np.log(x.clip(lower=1e-10))),
        (features.log1p, np.log1p(x.clip(lower=0))),
        (features.sqrt, np.sqrt(x.clip(lower=0))),
        (features.square, np.square(x)),
        (features.zscore, (x - x.mean()) / x.std()),
        (features.minmax, (x - x.min()) / (x.max() - x.min())),
    ):
        same(ordered(step(got, "x", "new"))[["new"]], want.to_frame())
    same(ordered(features.ratio(df, "x", "n", "new"))[["new"]], (frame["x"] / frame["n"].replace(0, np.nan)).to_frame())


def test_csv(spark, frame, tmp_path):
    path = tmp_path / "f.csv"
    frame.to_csv(path, index=False)
    want = pd.read_csv(path)
    got = read_csv(spark, str(path))
    assert got.columns == list(want.columns)
    assert dict(got.dtypes) == {"id": "bigint", "x": "double", "y": "double", "n": "bigint", "s": "string", "flag": "boolean"}
    back = ordered(got)
    same(back[["x", "y"]], want[["x", "y"]])
    assert [None if pd.isna(v) else v for v in back["s"]] == [None if pd.isna(v) else v for v in want["s"]]
    assert back["flag"].tolist() == want["flag"].tolist()
