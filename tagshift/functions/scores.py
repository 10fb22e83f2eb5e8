"""Classifier-score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: distance from a score of 1 below which scores count as this far from it
SURE = 1e-6


def odds(h: Column) -> Column:
    """h / (1 - h), with 1 - h no smaller than ``SURE``: a sure 4b event has large, finite odds."""
    return h / F.greatest(1.0 - h, F.lit(SURE))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(*logits: Column) -> list[Column]:
    top = F.greatest(*logits)
    terms = [F.exp(x - top) for x in logits]
    total = sum(terms[1:], terms[0])
    return [t / total for t in terms]


def hard_label(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def class_ratio(p4: Column, p3: Column) -> Column:
    return F.when(p3 != 0.0, p4 / p3)


def one_hot(label: Column, classes: int) -> list[Column]:
    return [F.when(label == c, 1).otherwise(0) for c in range(classes)]


def log_loss_term(label: Column, p1: Column) -> Column:
    return -F.log(F.when(label == 1, p1).otherwise(1.0 - p1))
