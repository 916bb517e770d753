"""Coordinates, projection and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A, FLAT = 6378137.0, 1 / 298.257223563
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
K0, EAST, SOUTH = 0.9996, 500000.0, 10000000.0


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by the transverse Mercator series."""
    e = 2 * N**0.5 / (1 + N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)), F.lit(0.0))
    return x * (K0 * RADIUS) + EAST, y * (K0 * RADIUS) + F.when(lat < 0, SOUTH).otherwise(0.0)


def lonlat(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing."""
    xi, eta = (y - F.when(south, SOUTH).otherwise(0.0)) / (K0 * RADIUS), (x - EAST) / (K0 * RADIUS)
    xi1 = xi - sum((b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(BETA)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(BETA)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(DELTA)), F.lit(0.0))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def pixel_of(x: Column, y: Column, minx: Column, maxy: Column, res: float) -> tuple[Column, Column]:
    """(column, row) of a point."""
    return F.floor((x - minx) / res), F.floor((maxy - y) / res)


def centre_of(col: Column, row: Column, minx: Column, maxy: Column, res: float) -> tuple[Column, Column]:
    return minx + (col + 0.5) * res, maxy - (row + 0.5) * res


def snapped(low: Column, high: Column, res: float, most: float) -> tuple[Column, Column, Column]:
    """Bounds moved outward to the grid, and whether they are wider than ``most``."""
    lo, hi = F.floor(low / res) * res, F.ceil(high / res) * res
    return lo.cast("double"), hi.cast("double"), hi - lo > most


def centred(low: Column, high: Column, centre: Column, res: float, most: float) -> tuple[Column, Column, Column]:
    """Bounds no wider than ``most``, about the centre where they are, moved outward to the grid; and whether they were cut."""
    wide = high - low > most
    lo, hi = F.when(wide, centre - most / 2).otherwise(low), F.when(wide, centre + most / 2).otherwise(high)
    return (F.floor(lo / res) * res).cast("double"), (F.ceil(hi / res) * res).cast("double"), wide


def slug(name: Column, kind: str, key: Column) -> Column:
    body = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(body, F.lit(f"-{kind}"), key.cast("string"))


PAIR = r"^\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*$"


def coordinates(query: Column, lat=(6, 38), lon=(68, 98)) -> tuple[Column, Column]:
    """Latitude and longitude where a query is a pair of numbers within the box, else nulls."""
    a, b = (F.regexp_extract(query, PAIR, k).try_cast("double") for k in (1, 2))
    ok = a.between(*lat) & b.between(*lon)
    return F.when(ok, a), F.when(ok, b)
