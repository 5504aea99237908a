"""Column functions: hash randomness, relevance and utility."""

from rarespark.functions.relevance import ControlPoints, phi
from rarespark.functions.rng import uniform
from rarespark.functions.utility import utility

__all__ = ["ControlPoints", "phi", "uniform", "utility"]
