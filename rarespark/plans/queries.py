"""The engine's queries over the driver's tables; ``oracles`` has the same in SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespark import cli
from rarespark.functions.relevance import phi
from rarespark.functions.utility import utility
from rarespark.operators import bumps, counts, draws, metrics, series, summary, synth
from rarespark.operators.relevance import control_points, control_points_by, resolve, tukey_hinges
from rarespark.operators.resampler import Resampler
from rarespark.plans import splits
from rarespark.plans.evaluate import default_strategies, evaluate
from rarespark.sources.series import cell, imputed, moment, number, read_series
from rarespark.sources.shared import shared_folder, written

SEED, FEATURES, THRESHOLD = 42, ["x0", "x1", "x2", "x3"], 0.9
BIASES = {"b": None, "t": "temporal", "tphi": "temporal+phi"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_index(table(spark, sf_dir, "events"), "value", ["ts", "event_id"])


def diff_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.difference(value_series(spark, sf_dir))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedded differences, written once: every query below reads them more than once."""
    return written(series.embed(diff_series(spark, sf_dir), 3, checked=False), "query-frame")


def _r(*names: str, places: int = 6):
    return [F.round(n, places).alias(n) for n in names]


def _cp_row(spark: SparkSession, cp) -> DataFrame:
    return spark.createDataFrame([(cp.x_lo, cp.p_lo, cp.med, cp.x_hi, cp.p_hi)], "x_lo double, p_lo double, med double, x_hi double, p_hi double").select(*_r("x_lo"), "p_lo", *_r("med", "x_hi"), "p_hi")


def series_index(spark, sf_dir):
    return value_series(spark, sf_dir).select("t", *_r("y"))


def first_difference(spark, sf_dir):
    return diff_series(spark, sf_dir).select("t", *_r("y"))


def tukey(spark, sf_dir):
    return spark.createDataFrame([tukey_hinges(table(spark, sf_dir, "events"), "value")], "q1 double, med double, q3 double").select(*_r("q1", "med", "q3"))


def control_points_one_sided(spark, sf_dir):
    return _cp_row(spark, control_points(table(spark, sf_dir, "events"), "value"))


def control_points_two_sided(spark, sf_dir):
    return _cp_row(spark, control_points(diff_series(spark, sf_dir), "y"))


def control_points_by_type(spark, sf_dir):
    got = control_points_by(table(spark, sf_dir, "events"), "value", "event_type")
    return got.select("event_type", "n", *_r("q1", "med", "q3", "x_lo"), "p_lo", *_r("x_hi"), "p_hi")


def phi_scores(spark, sf_dir):
    s = diff_series(spark, sf_dir)
    p = phi("y", control_points(s, "y"))
    return s.select("t", F.round(p, 6).alias("phi"), (p >= THRESHOLD).alias("rare"))


def phi_tied_knots(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.when(F.col("event_id") % 5 == 0, F.col("value")).otherwise(1.0).alias("y"))
    return s.select("t", F.round(phi("y", control_points(s, "y")), 6).alias("phi"))


def imbalance_summary(spark, sf_dir):
    return summary.imbalance_summary(table(spark, sf_dir, "events"), "value").select("N", "n_normal", "n_rare", *_r("IR", "pct_rare"))


def imbalance_summary_by_type(spark, sf_dir):
    return summary.imbalance_summary_by(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", "N", "n_normal", "n_rare", *_r("IR", "pct_rare"))


def imbalance_no_rare(spark, sf_dir):
    return summary.imbalance_summary(table(spark, sf_dir, "orders"), "o_totalprice").select("N", "n_normal", "n_rare", *_r("IR", "pct_rare"))


def embed_k8(spark, sf_dir):
    return series.embed(value_series(spark, sf_dir), 8, checked=False).select("t", *_r(*(f"x{i}" for i in range(9)), "y"))


def embed_horizon3_exog(spark, sf_dir):
    s = series.position(table(spark, sf_dir, "events"), ["ts", "event_id"], "t").select("t", F.col("value").alias("y"), "user_id")
    return series.embed(s, 2, 3, exog=["user_id"]).select("t", *_r("x0", "x1", "x2"), "user_id", *_r("y"))


def _gaps(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 97 != 13, F.col("value")))
    return series.series_index(ev, "value", ["ts", "event_id"])


def impute_drop(spark, sf_dir):
    return imputed(_gaps(spark, sf_dir), "drop").select("t", *_r("y"))


def impute_knn(spark, sf_dir):
    return imputed(_gaps(spark, sf_dir), "knn").select("t", *_r("y"))


def _labelled(spark, sf_dir, strategy: str, d: DataFrame | None = None) -> tuple[DataFrame, list[bumps.Bump], int]:
    d = d or frame(spark, sf_dir)
    got, found = Resampler(strategy).labelled(d, "y", "t", listed=bumps.measured)
    n = sum(b.size for b in found)
    return got, counts.assign(found, n, strategy), n


def _bump_rows(spark, found, *fields: str) -> DataFrame:
    kinds = {"bump": "int", "size": "bigint", "mean_phi": "double", "rare": "boolean", "normal": "boolean", "c": "double", "n_out": "bigint"}
    return spark.createDataFrame([tuple(float(getattr(b, f)) if kinds[f] == "double" else getattr(b, f) for f in fields) for b in found], ", ".join(f"{f} {kinds[f]}" for f in fields))


def _bumps(strategy: str):
    def run(spark, sf_dir):
        return _bump_rows(spark, _labelled(spark, sf_dir, strategy)[1], "bump", "size", "mean_phi", "rare", "normal").withColumn("mean_phi", F.round("mean_phi", 6))

    return run


def _targets(strategy: str):
    def run(spark, sf_dir):
        return _bump_rows(spark, _labelled(spark, sf_dir, strategy)[1], "bump", "size", "rare", "normal", "c", "n_out").withColumn("c", F.round("c", 6))

    return run


def _prefs(bias: str | None):
    def run(spark, sf_dir):
        got, found, _ = _labelled(spark, sf_dir, "under")
        return draws.preferences(draws.ranked(got, found, "t"), bias).select("t", "bump", "rank", F.round("p", 9).alias("p"))

    return run


def draw_without_replacement(spark, sf_dir):
    got, found, _ = _labelled(spark, sf_dir, "under")
    return draws.without_replacement(draws.ranked(got, found, "t"), [b for b in found if b.n_out < b.size], "temporal", SEED, "t").select("bump", "t")


def draw_with_replacement(spark, sf_dir):
    got, found, _ = _labelled(spark, sf_dir, "over")
    extra = {b.bump: b.n_out - b.size for b in found}
    return draws.with_replacement(draws.ranked(got, found, "t"), [b for b in found if extra[b.bump]], extra, "temporal", SEED).select("bump", "draw", "rank", "t")


def draw_topup(spark, sf_dir):
    """All but one case of each normal bump, by a weight that is 0 for some."""
    got, found, _ = _labelled(spark, sf_dir, "under")
    chosen = [b for b in found if b.normal]
    for b in chosen:
        b.n_out = b.size - 1
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return draws.without_replacement(draws.ranked(got, found, "t"), chosen, "temporal+phi", SEED, "t").select("bump", "t")


def _resampled(strategy: str, bias: str | None, quirks: bool = True):
    def run(spark, sf_dir):
        got = Resampler(strategy, bias, r_quirks=quirks, seed=SEED).fit_resample(frame(spark, sf_dir), FEATURES, "y", "t")
        return got.select("t", *_r("x0", "x3", "y"), "origin", "seq")

    return run


def knn_neighbours(spark, sf_dir):
    got, found, n = _labelled(spark, sf_dir, "over")
    cases = series.position(got.where(F.col("bump").isin([b.bump for b in found if b.rare])), ["y", "t"], "pos", ["bump"], n)
    return synth.neighbours(cases, FEATURES, 5).select("bump", "pos", "nn_rank", "nn")


def synthetic_cases(spark, sf_dir):
    got, found, _ = _labelled(spark, sf_dir, "smote")
    jobs = [b for b in found if b.n_out > b.size]
    return synth.synthesize(got, jobs, FEATURES, "y", "t", "temporal", 5, SEED).select("bump", "pos", F.col("copy").cast("int").alias("copy"), "nn_pos", "seed_t", *_r("x0", "y"))


def utility_scores(spark, sf_dir):
    d = frame(spark, sf_dir)
    return d.select("t", F.round(utility("x0", "y", control_points(d, "y")), 6).alias("u"))


def _metric(name: str):
    def run(spark, sf_dir):
        return metrics.evaluate_metrics(frame(spark, sf_dir), "y", "x0").select(F.round(name, 6).alias(name))

    return run


def sera(spark, sf_dir):
    return metrics.evaluate_metrics(frame(spark, sf_dir), "y", "x0").select(F.round(F.col("sera") / 1000.0, 4).alias("sera_thousands"))


def sera_curve(spark, sf_dir):
    return metrics.sera_curve(frame(spark, sf_dir), "y", "x0").select("t", F.round("ser", 2).alias("ser"))


def _windows(spark, sf_dir):
    return list(splits.temporal_windows(table(spark, sf_dir, "events").count(), seed=7))


def temporal_splits(spark, sf_dir):
    return splits.split_table(spark, _windows(spark, sf_dir))


def split_windows(spark, sf_dir):
    got = splits.split_frames(value_series(spark, sf_dir), _windows(spark, sf_dir))
    return got.groupBy("split", "part").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.round(F.avg("y"), 6).alias("mean_y"))


def resample_noop(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x0"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = Resampler("under").fit_resample(d, ["x0"], "y", "t")
    return got.select("t", *_r("y"), "origin")


def table1_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("y"))
    rows = None
    for ident, name, s in (("E1", "events.value", value_series(spark, sf_dir)), ("E2", "events.value differenced", diff_series(spark, sf_dir)), ("D1", "documents.n_chars", docs)):
        one = summary.imbalance_summary(s, "y").select(F.lit(ident).alias("id"), F.lit(name).alias("dataset"), "N", "n_normal", "n_rare", *_r("IR", "pct_rare")).withColumns({c: F.round(c, 2) for c in ("IR", "pct_rare")})
        rows = one if rows is None else rows.unionByName(one)
    return rows


def evaluate_grid(spark, sf_dir):
    """The default 50 splits of the ten strategies with least squares; all four metrics."""
    d = frame(spark, sf_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return evaluate(d, FEATURES, strategies=default_strategies(SEED))


# ---- sources ----------------------------------------------------------------------------------


def _spelled(spark, sf_dir) -> DataFrame:
    """Event values in ten spellings, of which some are no numbers."""
    v = F.format_string("%.3f", "value")
    kinds = [v, F.concat(F.lit("  "), v, F.lit(" ")), F.concat(v, F.lit("e2")), F.concat(F.lit("+"), v), F.concat(v, F.lit("d")), F.lit("1,234"), F.lit("NA"), F.lit("0x1F"), F.concat(v, F.lit("f")), F.lit(".5")]
    cell = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        cell = F.when(F.col("event_id") % 10 == i, kind).otherwise(cell)
    return table(spark, sf_dir, "events").select("event_id", cell.alias("text"))


def strict_numbers(spark, sf_dir):
    text = cell(F.col("text"))
    return _spelled(spark, sf_dir).select("event_id", text.isNull().alias("missing"), F.round(number(text), 6).alias("y"))


def date_order(spark, sf_dir):
    """Positions of events whose times are spelled in five forms or missing, ties in order of id."""
    at, forms = F.col("ts").cast("timestamp"), ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "d.M.yyyy H:mm", "yyyyMMdd")
    text = F.when(F.col("event_id") % 11 == 0, F.lit("NA"))
    for i, form in enumerate(forms):
        text = text.when(F.col("event_id") % 5 == i, F.date_format(at, form))
    ev = table(spark, sf_dir, "events").select("event_id", moment(cell(text)).alias("at"))
    got = series.position(ev.withColumn("last", F.col("at").isNull().cast("int")), ["last", "at", "event_id"], "t")
    return got.select("event_id", "t")


def _csv(spark, sf_dir, df: DataFrame, name: str) -> str:
    """``df`` as one CSV file in the shared folder."""
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(place)
    return place


def csv_series(spark, sf_dir):
    """Event values written to CSV in order of id, read back, put in order of time, gaps dropped, differenced."""
    ev = table(spark, sf_dir, "events").orderBy("event_id")
    text = ev.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("when"), F.when(F.col("event_id") % 97 != 13, F.col("value").cast("string")).otherwise(F.lit("NA")).alias("v"))
    return read_series(spark, _csv(spark, sf_dir, text, "series"), "v", "when", diff=True, impute="drop").select("t", *_r("y"))


def csv_manifest(spark, sf_dir):
    """The command line's table of a manifest of three series."""
    ev = table(spark, sf_dir, "events").orderBy("ts", "event_id").select("value")
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").select(F.col("n_chars").cast("string").alias("n"))
    a, b = _csv(spark, sf_dir, ev, "series"), _csv(spark, sf_dir, docs, "series")
    with tempfile.TemporaryDirectory() as own:  # a manifest is the driver's own file
        path = os.path.join(own, "manifest.csv")
        with open(path, "w", encoding="utf-8") as f:
            f.write(f"id,name,granularity,path,target,threshold,k\nA,values,,{a},value,,0\nB,later values,s,{a},value,0.8,\nC,lengths,,{b},n,,4\n")
        rows = cli.table1(spark, cli.parser().parse_args(["--config", path]))
    schema = "id string, dataset string, N bigint, granularity string, n_normal bigint, n_rare bigint, IR double, pct_rare double"
    return spark.createDataFrame([tuple(r[c] for c in cli.COLUMNS) for r in rows], schema)


# ---- forms of relevance, fallbacks, explicit percentages, refusals ------------------------------


def phi_given(spark, sf_dir):
    """phi of control points given as rows, as a column, and as a function of the target."""
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.col("value").cast("double").alias("y"))
    rows = resolve([(20.0, 1.0, 0.0), (50.0, 0.0, 0.0), (120.0, 0.5, 0.0)], d, "y")[0]
    column = resolve(F.col("y") / (F.abs(F.col("y")) + 100.0) * 0.5 + 0.5, d, "y")[0]
    function = resolve(lambda y: F.when(y > 60.0, 1.0).otherwise(0.25), d, "y")[0]
    return d.select("t", *(F.round(p, 6).alias(n) for n, p in (("by_rows", rows), ("by_column", column), ("by_function", function))))


def prefs_no_weight(spark, sf_dir):
    """Preferences where no case of a bump has any weight: all alike."""
    got, found, _ = _labelled(spark, sf_dir, "under")
    ranked = draws.ranked(got, found, "t").withColumn("phi", F.when(F.col("bump") == found[0].bump, 0.0).otherwise(F.col("phi")))
    return draws.preferences(ranked, "temporal+phi").select("t", "bump", F.round("p", 9).alias("p"))


def bump_targets_given(spark, sf_dir):
    """Sizes by given percentages: each of the strategies with the ones it takes."""
    rows, d = None, frame(spark, sf_dir)
    for strategy, o, u in (("under", None, 0.3), ("over", 1.7, None), ("smote", 2.6, 0.45), ("smote", 3.25, None), ("smote", None, 0.2)):
        got, found, n = _labelled(spark, sf_dir, strategy, d)
        one = _bump_rows(spark, counts.assign(found, n, strategy, o, u), "bump", "size", "c", "n_out").withColumns({"strategy": F.lit(strategy), "o": F.lit(o).cast("double"), "u": F.lit(u).cast("double")})
        rows = one if rows is None else rows.unionByName(one)
    return rows


def refusals(spark, sf_dir):
    """What is refused, and that it is refused with a ValueError."""
    d = spark.range(30).select(F.col("id").alias("t"), F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("x0"))
    hollow = d.withColumn("y", F.when(F.col("t") != 3, F.col("y")))
    cases = {
        "embed: k": lambda: series.embed(d, 0),
        "embed: horizon": lambda: series.embed(d, 1, 0),
        "embed: too short": lambda: series.embed(d, 30),
        "embed: missing value": lambda: series.embed(hollow, 1),
        "under with o": lambda: Resampler("under", o=2.0).fit_resample(d, ["x0"], "y", "t"),
        "over with u": lambda: Resampler("over", u=0.5).fit_resample(d, ["x0"], "y", "t"),
        "over below 1": lambda: Resampler("over", o=0.5).fit_resample(d, ["x0"], "y", "t"),
        "negative u": lambda: Resampler("smote", u=-0.5).fit_resample(d, ["x0"], "y", "t"),
        "unknown strategy": lambda: Resampler("both").fit_resample(d, ["x0"], "y", "t"),
        "unknown bias": lambda: Resampler("under", "spatial").fit_resample(d, ["x0"], "y", "t"),
        "k of neighbours": lambda: Resampler("smote", k=0).fit_resample(d, ["x0"], "y", "t"),
        "unknown parameter": lambda: Resampler().set_params(depth=3),
        "two control points": lambda: resolve([(0, 0), (1, 1)], d, "y"),
        "a slope": lambda: resolve([(0, 0, 0), (1, 0, 1), (2, 1, 0)], d, "y"),
        "phi above 1": lambda: resolve(F.lit(1.5), d, "y"),
        "relevance by name": lambda: resolve("always", d, "y"),
        "metric of a column": lambda: metrics.evaluate_metrics(d, "y", "x0", F.lit(0.5)),
        "metric of missing values": lambda: metrics.evaluate_metrics(hollow, "y", "x0"),
        "sera: step": lambda: metrics.evaluate_metrics(d, "y", "x0", step=0.3),
        "imputation by name": lambda: imputed(hollow, "mean"),
        "gaps refused": lambda: imputed(hollow, None),
        "splits: too long": lambda: list(splits.temporal_split(d, 2, 0.8, 0.3)),
        "splits: empty window": lambda: list(splits.temporal_windows(3, 2, 0.5, 0.25)),
        "command line: no source": lambda: cli.table1(spark, cli.parser().parse_args([])),
        "command line: coef": lambda: cli.table1(spark, cli.parser().parse_args(["x.csv", "--target", "v", "--coef", "2"])),
        "command line: one end": lambda: cli.table1(spark, cli.parser().parse_args(["x.csv", "--target", "v", "--xtrm-type", "high"])),
        "command line: k": lambda: cli.table1(spark, cli.parser().parse_args(["x.csv", "--target", "v", "--k", "-1"])),
        "nothing is wrong": lambda: None,
    }
    rows = []
    for name, call in cases.items():
        try:
            call()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "case string, refused boolean")


def evaluate_persistence(spark, sf_dir):
    """All four metrics of the last value as forecast, over 50 splits, without resampling; control
    points are those of each training window."""

    class Last:
        def fit(self, df, features, target):
            return self

        def predict(self, df):
            return df.withColumn("prediction", F.col("x0"))

    got = evaluate(frame(spark, sf_dir), FEATURES, estimator=Last(), strategies={"baseline": None}, seed=7)
    return got.withColumn("value", F.round(F.when(F.col("metric") == "sera", F.col("value") / 1000.0).otherwise(F.col("value")), 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (series_index, first_difference, control_points_one_sided, control_points_two_sided, control_points_by_type, phi_scores, phi_tied_knots, imbalance_summary, imbalance_summary_by_type, imbalance_no_rare, embed_k8, embed_horizon3_exog, impute_drop, impute_knn, draw_without_replacement, draw_with_replacement, draw_topup, knn_neighbours, synthetic_cases, utility_scores, sera, sera_curve, temporal_splits, split_windows, resample_noop, table1_manifest, evaluate_grid, strict_numbers, date_order, csv_series, csv_manifest, phi_given, prefs_no_weight, bump_targets_given, refusals, evaluate_persistence)
    out = {f.__name__: f for f in plain}
    out["tukey_hinges"] = tukey
    for rule in ("over", "under"):
        out[f"bumps_{rule}"] = _bumps(rule)
    for strategy in counts.STRATEGIES:
        out[f"bump_targets_{strategy}"] = _targets(strategy)
        for suffix, bias in BIASES.items():
            out[f"{strategy}_{suffix}"] = _resampled(strategy, bias)
    out["smote_tphi_no_quirks"] = _resampled("smote", "temporal+phi", False)
    for name, bias in (("uniform", None), ("temporal", "temporal"), ("temporal_phi", "temporal+phi")):
        out[f"prefs_{name}"] = _prefs(bias)
    for name in ("precision_phi", "recall_phi", "f1_phi"):
        out[name] = _metric(name)
    return out
