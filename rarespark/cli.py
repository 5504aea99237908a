"""Command line: imbalance tables of one series or of a manifest's.

Exit status 0, or 2 with ``error: ...`` on stderr.
"""

from __future__ import annotations

import argparse
import sys
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from rarespark.operators.summary import imbalance_summary
from rarespark.sources.series import read_manifest, read_series

SIDE_BY_SIDE = 8
COLUMNS = ["ID", "Dataset", "N", "Granularity", "n_normal", "n_rare", "IR", "%Rare"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rarespark", description="Counts rare and normal cases of one or many series.")
    p.add_argument("csv_path", nargs="?", help="a series to read")
    p.add_argument("--target", help="which column holds the series' values")
    p.add_argument("--id", default="DS1")
    p.add_argument("--name", help="shown in the table; the target's name if not given")
    p.add_argument("--granularity", default="")
    p.add_argument("--date-col", help="put rows in this column's order first (single series only)")
    p.add_argument("--config", help="read a list of series from this CSV instead")
    p.add_argument("--threshold", type=float, default=0.9)
    p.add_argument("--k", type=int, default=10, help="how many first values no embedded case predicts")
    p.add_argument("--no-embed", action="store_true")
    p.add_argument("--diff", action="store_true")
    p.add_argument("--xtrm-type", default="both")
    p.add_argument("--coef", type=float, default=1.5)
    p.add_argument("--impute", choices=["knn", "drop", "none"], default="knn")
    p.add_argument("--output", help="where to save the table as CSV")
    return p


def _row(spark: SparkSession, a: argparse.Namespace, path: str, target: str, date_col: str | None, ident: str, name: str, granularity: str, threshold: float, k: int) -> dict:
    if k < 0:
        raise ValueError(f"k must be >= 0; got {k}")
    series = read_series(spark, path, target, date_col, a.diff, None if a.impute == "none" else a.impute)
    if not a.no_embed:
        series = series.where(f"t >= {k}")
    s = imbalance_summary(series, "y", threshold).first()
    return dict(zip(COLUMNS, (ident, name, s.N, granularity, s.n_normal, s.n_rare, round(s.IR, 2), round(s.pct_rare, 2)), strict=True))


def table1(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    if a.xtrm_type != "both":
        raise ValueError("--xtrm-type knows just 'both': rare cases are looked for at either end")
    if a.coef != 1.5:
        raise ValueError("--coef is fixed at 1.5, the length of the whiskers")
    if a.k < 0:
        raise ValueError(f"--k must be >= 0; got {a.k}")
    if bool(a.csv_path) == bool(a.config):
        raise ValueError("name one source: a CSV path or --config")
    if a.config:

        def one(m: dict[str, str]) -> dict:
            return _row(spark, a, m["path"], m["target"], None, m["id"], m["name"], m.get("granularity") or "", float(m.get("threshold") or a.threshold), int(m.get("k") or a.k))

        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:  # their jobs share the executors
            return list(pool.map(one, read_manifest(a.config)))
    if not a.target:
        raise ValueError("--target is required with a CSV path")
    return [_row(spark, a, a.csv_path, a.target, a.date_col, a.id, a.name or a.target, a.granularity, a.threshold, a.k)]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    import pandas as pd
    from pyspark.errors import PySparkException

    args = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("rarespark").getOrCreate()
        table = pd.DataFrame(table1(spark, args), columns=COLUMNS)
        if args.output:
            table.to_csv(args.output, index=False)
    except (ValueError, OSError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(table.to_string(index=False))
    return 0
