"""Key groups: a fixed number of hash ranges that any number of subtasks shares out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number of groups, and the constants of the 64-bit FNV-1a hash.
GROUPS = 128
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    state = FNV_START
    for byte in data:
        state = (state ^ byte) * FNV_FACTOR % 2**64
    return state


def group_of_text(key: str | None) -> int | None:
    """Group of a text key, encoded as its length (unsigned 32-bit, little-endian) and its UTF-8 bytes."""
    if key is None:
        return None
    raw = key.encode()
    return fnv1a(len(raw).to_bytes(4, "little") + raw) % GROUPS


def _groups(keys: pd.Series) -> pd.Series:
    known = {k: group_of_text(k) for k in keys.unique()}
    return keys.map(known).astype("Int32")


def group_of(key: Column) -> Column:
    """The product of 64-bit numbers overflows in SQL, so the hash is taken in Arrow batches, once a distinct key."""
    return F.pandas_udf(_groups, "int")(key)


def subtask(group: Column, parallelism: int) -> Column:
    return F.floor(group * parallelism / GROUPS).cast("int")


def range_for(task: int, parallelism: int) -> tuple[int, int]:
    """Groups [first, end) of a subtask: those that subtask() gives it."""
    return -(-task * GROUPS // parallelism), -(-(task + 1) * GROUPS // parallelism)
