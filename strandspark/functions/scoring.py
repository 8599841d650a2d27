"""Position-specific scoring matrices: [position class][reference base][read base]."""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..config import Settings


def flat(settings: Settings = Settings()) -> np.ndarray:
    """One match and one mismatch score everywhere."""
    out = np.full((2 * settings.pssm_depth + 1, 5, 5), settings.flat_mismatch, dtype=np.int32)
    for k in range(4):
        out[:, k, k] = settings.flat_match
    out[:, :, 4] = settings.read_n_score
    out[:, 4, :] = settings.ref_n_score
    return out


def parse(text: str, settings: Settings = Settings()) -> np.ndarray:
    """Read 31 blocks of 4 x 4 integers: from the 5' end, the middle, towards the 3' end."""
    depth = settings.pssm_depth
    names = [str(k) for k in range(1, depth + 1)] + ["MIDDLE"] + [str(-k) for k in range(depth, 0, -1)]
    blocks = re.split(r"(?m)^#[^\n]*position:\s*(\S+)\s*$", text)[1:]
    if [b.strip() for b in blocks[::2]] != names:
        raise ValueError("the matrix file lacks a position or has them in another order")
    out = flat(settings)
    for k, block in enumerate(blocks[1::2]):
        values = np.asarray(block.split(), dtype=np.int32)
        if values.size != 16:
            raise ValueError(f"matrix {names[k]} has {values.size} numbers, not 16")
        out[k, :4, :4] = values.reshape(4, 4)
    return out


def find(name: str, folders: list[str] | None = None) -> str:
    """The path of a matrix file: as it is if it exists or has a slash, else from ``folders``."""
    if "/" in name or os.path.exists(name):
        return name
    for folder in folders or []:
        if os.path.exists(path := os.path.join(folder, name)):
            return path
    have = sorted(x for f in folders or [] if os.path.isdir(f) for x in os.listdir(f))
    raise FileNotFoundError(f"no matrix {name!r}; there are: {', '.join(have) or 'none'}")


def reverse(matrix: np.ndarray) -> np.ndarray:
    """The matrices for reads of the other strand: classes mirrored, bases complemented."""
    order = [3, 2, 1, 0, 4]
    return np.ascontiguousarray(matrix[::-1][:, order][:, :, order])


def table(spark: SparkSession, forward: np.ndarray, backward: np.ndarray | None = None) -> DataFrame:
    """(``rc``, ``depth``, ``read_b``, ``a``, ``c``, ``g``, ``t``): 310 rows, a fixed size."""
    backward = reverse(forward) if backward is None else backward
    rows = [(rc, d, b, *[int(m[d, x, b]) for x in range(4)]) for rc, m in ((False, forward), (True, backward)) for d in range(m.shape[0]) for b in range(5)]
    return spark.createDataFrame(rows, "rc boolean, depth int, read_b int, sa int, sc int, sg int, st int")
