"""Recodes of census person records as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def race_ethnicity(race: Column, hispanic: Column) -> Column:
    """4 Hispanic, 1 White, 2 Black, 3 Asian, 5 other; a null origin leaves the race to decide, a null race is other."""
    return F.when(hispanic > 1, 4).when(race == 1, 1).when(race == 2, 2).when(race == 6, 3).otherwise(5)


def education(level: Column) -> Column:
    """1 below high school, 2 high school, 3 some college, 4 bachelor, 5 graduate; beyond the scale 1, null stays null."""
    steps = ((15, 1), (17, 2), (20, 3), (21, 4), (24, 5))
    out = F.when(level.isNull(), None)
    for top, code in steps:
        out = out.when(level <= top, code)
    return out.otherwise(1)


def birthplace(place: Column) -> Column:
    """1 California, 2 other state, 3 Mexico, 4 Europe, 5 Asia, 6 Latin America, 7 elsewhere or null."""
    return (
        F.when(place == 6, 1).when(place.between(1, 56), 2).when(place == 303, 3).when(place.between(200, 299), 5)
        .when(place.between(300, 399), 6).when(place.between(100, 199), 4).otherwise(7)
    )


def binarize(source: Column, threshold: float) -> Column:
    """1 above the threshold, else 0; null is 0."""
    return F.coalesce((F.nanvl(source.cast("double"), F.lit(None)) > threshold), F.lit(False)).cast("int")
