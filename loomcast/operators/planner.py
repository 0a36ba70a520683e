"""Where to search: detection rates of depth bands, their prior by the time of day, and a choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seeds import derive_seed

#: Hours of the crossings around sunset and sunrise, and the corridor's depths.
SUNSET, SUNRISE, DUSK, DAWN, CORRIDOR, NIGHT_DEPTH = 18.5, 6.5, (-1.0, 1.5), (-2.5, 0.5), (100.0, 200.0), 60.0
#: The rate expected of a band before anything is seen, and its weight in seconds.
PRIOR_PER_MIN, PRIOR_S = 0.05, 60.0


def after(hour: Column, mark: float) -> Column:
    """Hours after a mark on the clock, -12 to 12."""
    return F.pmod(hour - mark + 12.0, F.lit(24.0)) - 12.0


def crossing(hour: Column) -> Column:
    return after(hour, SUNSET).between(*DUSK) | after(hour, SUNRISE).between(*DAWN)


def diel_prior(band: Column, hour: Column) -> Column:
    """How much likelier animals are in a band at an hour: the corridor while they cross it, shallow
    water at night, nothing by day."""
    night = (hour < SUNRISE) | (hour >= SUNSET)
    shallow = F.exp(-0.5 * F.pow((band - NIGHT_DEPTH) / 40.0, F.lit(2.0))) * 2.0 + 0.5
    return F.when(crossing(hour), F.when(band.between(*CORRIDOR), 3.0).otherwise(1.0)).when(night, shallow).otherwise(1.0)


def posterior_rate(events: Column, exposure: Column, prior_per_min: float = PRIOR_PER_MIN, prior_s: float = PRIOR_S) -> Column:
    """Detections a minute, with a prior."""
    return 60.0 * (events + prior_per_min / 60.0 * prior_s) / (exposure + prior_s)


def choose_bands(df: DataFrame, key: str, seed: int, prior_per_min: float = PRIOR_PER_MIN, prior_s: float = PRIOR_S) -> DataFrame:
    """(key, band): a draw from the posterior of each reachable band's rate, the largest wins. Rows are
    (key, band, events, exposure, prior, reachable); where no band is reachable, all are. A key has a
    few dozen bands."""

    def run(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("band")
        rng = np.random.default_rng(derive_seed(seed, "band", str(k[0])))
        shape = part["events"] + prior_per_min / 60.0 * prior_s * part["prior"]
        draw = rng.gamma(np.maximum(shape, 1e-3), 1.0 / (part["exposure"] + prior_s))
        open_ = part["reachable"].to_numpy(dtype=bool)
        draw = np.where(open_ | ~open_.any(), draw, -1.0)
        return pd.DataFrame({key: [k[0]], "band": [float(part["band"].iloc[int(draw.argmax())])]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "band", "events", "exposure", "prior", "reachable").groupBy(key).applyInPandas(run, f"`{key}` {kind}, band double")


def reachable(band: Column, low: Column, high: Column, width: float = 10.0) -> Column:
    """Whether a band's middle is within half a band of the depths that can be reached."""
    return band.between(low - width / 2, high + width / 2)


def best_band(df: DataFrame, key: str, prior_per_min: float = PRIOR_PER_MIN, prior_s: float = PRIOR_S) -> DataFrame:
    """(key, band): choose_bands without the draw: the reachable band with the largest expected rate, the
    shallowest of equals; where none is reachable, of all."""
    rate = (F.col("events") + prior_per_min / 60.0 * prior_s * F.col("prior")) / (F.col("exposure") + prior_s)
    return df.groupBy(key).agg(F.max_by("band", F.struct(F.col("reachable").cast("int"), rate, -F.col("band"))).alias("band"))
