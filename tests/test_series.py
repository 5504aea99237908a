"""Embedding, sources, imputation, the command line."""

import math
import random

import numpy as np
import pytest

from rarespark import embed, read_series
from rarespark.cli import main
from rarespark.sources.series import fill_gaps, imputed, read_manifest


def series(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "t bigint, y double")


def test_embed(spark):
    rows = embed(series(spark, range(10)), 2).orderBy("t").collect()
    assert len(rows) == 7
    assert (rows[0].x0, rows[0].x1, rows[0].x2, rows[0].y) == (2, 1, 0, 3)
    assert (rows[-1].x0, rows[-1].x1, rows[-1].x2, rows[-1].y) == (8, 7, 6, 9)


def test_embed_with_horizon_and_exogenous_column(spark):
    df = series(spark, range(5)).selectExpr("t", "y", "10D * t AS e")
    rows = embed(df, 1, exog=["e"]).orderBy("t").collect()
    assert [(r.x0, r.x1, r.e, r.y) for r in rows] == [(1, 0, 10, 2), (2, 1, 20, 3), (3, 2, 30, 4)]
    assert [r.y for r in embed(series(spark, range(6)), 1, 3).orderBy("t").collect()] == [4, 5]


def test_embed_checks(spark):
    s = series(spark, range(5))
    for kw, text in (({"k": 0}, "k >= 1"), ({"k": 1, "horizon": 0}, "horizon >= 1"), ({"k": 4}, "too short")):
        with pytest.raises(ValueError, match=text):
            embed(s, **kw)
    with pytest.raises(ValueError, match="finite"):
        embed(series(spark, [1, None, 3, 4]), 1)


def test_source_sorts_mixed_dates_and_differences(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('"when","v"\n1999-01-02,4\n1999-01-01 12:00:00,NA\n1999-01-01,1\n1999-01-03 00:30:00,16\n1999-01-03,9\n')
    got = read_series(spark, str(p), "v", "when", impute="drop").orderBy("t").collect()
    assert [(r.t, r.y) for r in got] == [(0, 1), (1, 4), (2, 9), (3, 16)]
    got = read_series(spark, str(p), "v", "when", diff=True, impute="drop").orderBy("t").collect()
    assert [r.y for r in got] == [3, 5, 7]
    with pytest.raises(ValueError, match="missing values"):
        read_series(spark, str(p), "v", impute=None)
    with pytest.raises(ValueError, match="not found.*available"):
        read_series(spark, str(p), "w")


def test_source_refuses_what_is_no_number(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('v\n1\n"1,234"\n3\n')
    with pytest.raises(ValueError, match="1 non-numeric.*1,234"):
        read_series(spark, str(p), "v")


def test_knn_fill_of_a_periodic_series_is_exact():
    s = np.array([float(i % 3) for i in range(60)])
    s[40] = np.nan
    assert fill_gaps(s)[40] == 1.0


def test_knn_fill_uses_earlier_fills_and_keeps_leading_gaps(spark):
    s = np.array([float(i % 3) for i in range(60)])
    s[[0, 1, 40, 41]] = np.nan
    got = fill_gaps(s)
    assert np.isnan(got[:2]).all() and got[40] == 1.0 and got[41] == 2.0
    with pytest.warns(UserWarning, match="dropped 2 leading"):
        out = imputed(series(spark, [None if math.isnan(v) else v for v in s]), "knn").orderBy("t").collect()
    assert len(out) == 58 and out[0].t == 0
    with pytest.raises(ValueError, match="gap-free window of 10"):
        fill_gaps(np.array([1.0, np.nan] * 10))


def test_manifest(tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("id,path\n1,x\n")
    with pytest.raises(ValueError, match=r"\['name', 'target'\]"):
        read_manifest(str(p))


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "s.csv"
    p.write_text("value\n" + "\n".join(map(str, [4, 1, 9, 2, 100, 3, 8, 5, 7, 6])) + "\n")
    out = tmp_path / "out.csv"
    assert main([str(p), "--target", "value", "--no-embed", "--output", str(out)], spark) == 0
    assert capsys.readouterr().out.split("\n")[1].split() == ["DS1", "value", "10", "8", "2", "0.25", "20.0"]
    assert out.read_text().startswith("ID,Dataset,N")
    m = tmp_path / "m.csv"
    m.write_text(f"id,name,granularity,path,target,threshold,k\nA,first,daily,{p},value,,0\n")
    assert main(["--config", str(m)], spark) == 0
    assert capsys.readouterr().out.split("\n")[1].split() == ["A", "first", "10", "daily", "8", "2", "0.25", "20.0"]


@pytest.mark.parametrize("argv", [[], ["x.csv"], ["x.csv", "--config", "m.csv"], ["x.csv", "--target", "v", "--coef", "2"], ["x.csv", "--target", "v", "--xtrm-type", "high"], ["x.csv", "--target", "v", "--k", "-1"], ["/no/such.csv", "--target", "v"]])
def test_command_line_errors(spark, argv, capsys):
    assert main(argv, spark) == 2
    assert capsys.readouterr().err.startswith("error: ")


def test_no_value_is_later_than_its_target(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(40)]
    at = {v: i for i, v in enumerate(values)}
    for r in embed(series(spark, values), 4, 2).collect():
        assert max(at[r[f"x{j}"]] for j in range(5)) < at[r.y]
