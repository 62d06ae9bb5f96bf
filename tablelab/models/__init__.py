"""Classifiers: fit a dataset, score class probabilities, save and load."""

from .classifiers import CLASSIFIERS, fit, fit_text, load, save
from .scoring import score, score_by_name, score_with

__all__ = ["CLASSIFIERS", "fit", "fit_text", "load", "save", "score", "score_by_name", "score_with"]
