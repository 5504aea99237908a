"""PySpark-native resampling and evaluation of imbalanced time-series regression data."""

from rarespark.functions import ControlPoints, phi
from rarespark.operators.metrics import evaluate_metrics, f1_phi, precision_phi, recall_phi, sera, sera_curve
from rarespark.operators.relevance import control_points
from rarespark.operators.resampler import Resampler
from rarespark.operators.series import embed
from rarespark.operators.summary import imbalance_summary
from rarespark.plans.evaluate import evaluate
from rarespark.plans.splits import temporal_split, temporal_windows
from rarespark.sources.series import read_series

__all__ = ["ControlPoints", "Resampler", "control_points", "embed", "evaluate", "evaluate_metrics", "f1_phi", "imbalance_summary", "phi", "precision_phi", "read_series", "recall_phi", "sera", "sera_curve", "temporal_split", "temporal_windows"]
