"""Seeds from any parts, the same in every process, and a hash split that keeps them bit for bit."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def derive_seed(*parts: object) -> int:
    """63 bits of blake2b over the parts' representations, each closed by a unit separator."""
    text = b"".join(repr(p).encode() + b"\x1f" for p in parts)
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") % (1 << 63)


def seeded01(seed: int, purpose: str, key: Column) -> Column:
    """A number in [0, 1) of a string key, in steps of 1 / 1000003; an Arrow batch at a time. Where
    agreement with recorded splits is not wanted, `columns.hash01` stays in generated code."""

    @F.pandas_udf("double")
    def run(keys: pd.Series) -> pd.Series:
        known = {k: derive_seed(seed, purpose, k) % 1_000_003 / 1_000_003 for k in keys.unique()}
        return keys.map(known)

    return run(key)
