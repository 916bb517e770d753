"""Spectral indices, masks and class rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that hide the ground: no data, saturated, shadow, clouds, cirrus.
BAD_SCL = (0, 1, 3, 8, 9, 10)
WATER, VEGETATION, BARE, BUILT = 0, 1, 2, 3
#: Scene class -> land class.
SCL_CLASS = {6: WATER, 4: VEGETATION, 5: BARE}
#: External nine-class layer -> land class.
EXTERNAL_CLASS = {0: WATER, 1: VEGETATION, 2: VEGETATION, 3: VEGETATION, 4: VEGETATION, 5: VEGETATION, 6: BUILT, 7: BARE}


def reflectance(dn: Column, offset: float = 0.0) -> Column:
    return dn * F.lit(1e-4) + F.lit(offset)


def corrected(dn: Column, offset_applied: Column) -> Column:
    """Digital numbers of scenes whose offset is still to be taken off."""
    return F.when(offset_applied, dn).when(dn > 0, F.greatest(dn - 1000, F.lit(1))).otherwise(0)


def norm_diff(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) within [-1, 1]; 0 where the sum is next to nothing."""
    total = a + b
    return F.when(F.abs(total) > 1e-6, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a - b) / F.when(F.abs(total) > 1e-6, total)))).otherwise(0.0)


def indices(green: Column, red: Column | None, nir: Column, swir: Column) -> dict[str, Column]:
    g, n, s = reflectance(green), reflectance(nir), reflectance(swir)
    ndvi = F.lit(0.0) if red is None else norm_diff(n, reflectance(red))
    return {"ndwi": norm_diff(g, n), "mndwi": norm_diff(g, s), "ndvi": ndvi, "ndbi": norm_diff(s, n)}


def cloudy(scl: Column, green: Column | None = None) -> Column:
    bad = scl.isin(*BAD_SCL)
    return bad if green is None else bad | (green == 0)


def water(mndwi: Column, scl: Column) -> Column:
    return (mndwi > 0) & ~cloudy(scl)


def vegetation(mndwi: Column, ndvi: Column, scl: Column) -> Column:
    return (ndvi > 0.30) & (mndwi <= 0) & ~cloudy(scl)


def index_class(mndwi: Column, ndvi: Column) -> Column:
    """Bare, unless green enough; water where wet, whatever else."""
    return F.when(mndwi > 0, WATER).when(ndvi > 0.30, VEGETATION).otherwise(BARE)


def recoded(code: Column, table: dict[int, int]) -> Column:
    """Class of a code; null for codes that the table lacks."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(lookup, code.cast("int"))


def seed_label(scl: Column, buildings: Column, region: Column) -> Column:
    """Seed class: outside and bad pixels none, then buildings, then the scene class."""
    return F.when(~region | cloudy(scl), F.lit(None)).when(buildings >= 1, BUILT).otherwise(recoded(scl, SCL_CLASS))


def building_conflict(scl: Column, buildings: Column) -> Column:
    return (buildings >= 1) & scl.isin(*[k for k, v in SCL_CLASS.items() if v == WATER])


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(parts, lambda x: x / total)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
