"""Random matrices, drawn with NumPy generators so that a seed always means the same numbers.

Repetition ``r`` uses ``seed + r``. Every table here has a size that the configuration fixes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..config import EncoderConfig, Projection


def hyperplanes(config: EncoderConfig, rep: int) -> np.ndarray:
    """Normals of the repetition's hyperplanes, dimension x bits (float32)."""
    draw = np.random.default_rng(config.seed + rep)
    return draw.normal(loc=0.0, scale=1.0, size=(config.dimension, config.bits)).astype(np.float32)


def signed_targets(size: int, targets: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``size`` inputs the output it is added to, and its sign."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, targets, size=size), draw.choice([-1.0, 1.0], size=size)


def projection_matrix(config: EncoderConfig, rep: int) -> np.ndarray:
    """dimension x width in doubles; one signed one a row, or the identity."""
    if config.projection is Projection.IDENTITY:
        return np.eye(config.dimension)
    target, sign = signed_targets(config.dimension, config.width, config.seed + rep)
    out = np.zeros((config.dimension, config.width))
    out[np.arange(config.dimension), target] = sign
    return out


def planes_frame(spark: SparkSession, config: EncoderConfig, reps: list[int] | None = None) -> DataFrame:
    """(rep, rep_pos, planes): one row a repetition, planes as bits x dimension doubles."""
    rows = [(r, i, hyperplanes(config, r).T.astype(float).tolist()) for i, r in enumerate(config.chosen(reps))]
    return spark.createDataFrame(rows, "rep int, rep_pos int, planes array<array<double>>")


def targets_frame(spark: SparkSession, config: EncoderConfig, reps: list[int] | None = None) -> DataFrame:
    """(rep, i, target, sign): where number i of a vector goes."""
    rows = []
    for r in config.chosen(reps):
        target, sign = signed_targets(config.dimension, config.width, config.seed + r) if config.projection is Projection.AMS else (np.arange(config.dimension), np.ones(config.dimension))
        rows += [(r, i, int(t), float(s)) for i, (t, s) in enumerate(zip(target, sign, strict=True))]
    return spark.createDataFrame(rows, "rep int, i int, target int, sign double")


def planes_sql(config: EncoderConfig) -> str:
    """VALUES rows (rep, bit, v) of all hyperplanes, for oracles."""
    rows = []
    for r in range(config.repetitions):
        rows += [f"({r}, {j}, [{', '.join(repr(float(x)) for x in v)}]::DOUBLE[])" for j, v in enumerate(hyperplanes(config, r).T)]
    return ", ".join(rows)


def targets_sql(config: EncoderConfig) -> str:
    """VALUES rows (rep, i, target, sign), for oracles."""
    rows = []
    for r in range(config.repetitions):
        target, sign = signed_targets(config.dimension, config.width, config.seed + r)
        rows += [f"({r}, {i}, {int(t)}, {float(s)})" for i, (t, s) in enumerate(zip(target, sign, strict=True))]
    return ", ".join(rows)
