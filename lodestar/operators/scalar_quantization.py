"""Scalar quantization to signed bytes by one scale for the whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.flat import rerank
from lodestar.operators.scan import SCORED_ROWS, Scorer, search


def train(base: DataFrame) -> float:
    """127 over the greatest absolute value of any coordinate (1 where all are 0); one value reaches the driver."""
    greatest = base.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))))).first()[0]
    return 127.0 / (greatest or 1.0)


def encode(v: Column, scale: float) -> Column:
    """Rounds half away from zero and clamps to [-128, 127]."""

    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        away = F.when(y < 0, F.ceil(y - 0.5)).otherwise(F.floor(y + 0.5))
        return F.greatest(F.lit(-128), F.least(F.lit(127), away)).cast("tinyint")

    return F.transform(v, one)


def encode_matrix(m: np.ndarray, scale: float) -> np.ndarray:
    y = m.astype(np.float64) * scale
    return np.clip(np.where(y < 0, np.ceil(y - 0.5), np.floor(y + 0.5)), -128, 127).astype(np.int64)


def encode_table(base: DataFrame, scale: float) -> DataFrame:
    """(id, code array<tinyint>)."""
    return base.select("id", encode(F.col("vec"), scale).alias("code"))


def sq_search(base: DataFrame, codes: DataFrame, scale: float, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """The ``nprobe`` rows with the greatest integer product, reranked by exact inner product."""

    def of(q: np.ndarray) -> Scorer:
        coded, every = encode_matrix(q, scale).astype(np.float64), np.arange(len(q))

        def score(columns: dict[str, np.ndarray]):
            code = columns["code"].astype(np.float64)  # products of bytes are exact in doubles
            for a in range(0, len(code), SCORED_ROWS):
                part = code[a : a + SCORED_ROWS]
                yield every, np.arange(a, a + len(part)), -(coded @ part.T)

        return score

    shortlist = search(codes.select("id", "code"), ["code"], queries, max(nprobe, k), of)
    return rerank(shortlist, base, queries, k, "ip")
