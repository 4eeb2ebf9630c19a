"""Nearest sites of recordings, on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.scale import broadcast_if_bounded, kept

EARTH_RADIUS_KM = 6371.0088
# Side of the first cells as a chord of the unit sphere, about 64 km; each round doubles it.
FIRST_CELL = 0.01
_XYZ = ("x", "y", "z")


def _on_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    """A place as a point of the unit sphere, where neither poles nor the date line are special."""
    a, b = F.radians(lat), F.radians(lon)
    return {"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)}


def _usable() -> Column:
    known = F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0)
    return F.coalesce(known, F.lit(False))


def _cell(side: float, shifts: list[Column] | None = None) -> list[Column]:
    cells = [F.floor(F.col(c) / side) for c in _XYZ]
    return cells if shifts is None else [c + s for c, s in zip(cells, shifts)]


def nearest_sites(recordings: DataFrame, sites: DataFrame, max_km: float | None = None) -> DataFrame:
    """Every recording with the nearest site, its ``site`` and ``distance_km``, by great circle (ties: smallest site).

    ``recordings`` has lat and lon, ``sites`` (site, lat, lon). Recordings without a usable place, further than ``max_km`` from
    every site, or where there are no sites, have nulls; sites without a usable place are left out. Columns of the same names in
    ``recordings`` are replaced; equal recordings are kept each.

    Recordings of one place are looked up once. A place is joined with the sites of its cell and the 26 around it, which hold
    every site nearer than a cell's side; places without one that near go on to cells of twice the side. So a place meets few
    sites wherever they are dense, and no pair of far ones.
    """
    places = recordings.where(_usable()).select("lat", "lon").distinct().withColumns(_on_sphere(F.col("lat"), F.col("lon")))
    points = sites.where(_usable() & F.col("site").isNotNull()).select("site", *[c.alias(n) for n, c in _on_sphere(F.col("lat"), F.col("lon")).items()])
    points = kept(points.groupBy(*_XYZ).agg(F.min("site").alias("site")))
    furthest = 2.0 if max_km is None else 2 * math.sin(min(max_km / EARTH_RADIUS_KM, math.pi) / 2)
    shift = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left, found, side = kept(places), None, FIRST_CELL
    while not (points.isEmpty() or left.isEmpty()):
        around = left
        for c in _XYZ:
            around = around.withColumn(f"s{c}", F.explode(shift))
        keys = [f"c{c}" for c in _XYZ]
        around = around.select("lat", "lon", *_XYZ, *[c.alias(k) for c, k in zip(_cell(side, [F.col(f"s{c}") for c in _XYZ]), keys)])
        near = points.select("site", *[F.col(c).alias(f"p{c}") for c in _XYZ], *[c.alias(k) for c, k in zip(_cell(side), keys)])
        chord = F.sqrt(sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in _XYZ), F.lit(0.0)))
        joined = around.join(broadcast_if_bounded(near), keys).withColumn("chord", chord)
        best = joined.groupBy("lat", "lon").agg(F.min(F.struct("chord", "site")).alias("best"))
        sure = kept(best.where(F.col("best.chord") <= min(side, furthest)).select("lat", "lon", "best.site", "best.chord"))
        found = sure if found is None else found.unionByName(sure)
        if side >= furthest:
            break
        left = kept(left.join(sure, ["lat", "lon"], "left_anti"))
        side *= 2
    if found is None:
        found = places.select("lat", "lon", F.lit(None).cast(sites.schema["site"].dataType).alias("site"), F.lit(None).cast("double").alias("chord"))
    km = F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.col("chord") / 2, F.lit(1.0)))
    answers = found.select("lat", "lon", "site", km.alias("distance_km"))
    return recordings.drop("site", "distance_km").join(answers, ["lat", "lon"], "left").select(
        *[c for c in recordings.columns if c not in ("site", "distance_km")], "site", "distance_km"
    )


def site_scores(scores: DataFrame, sites: DataFrame) -> DataFrame:
    """Occurrence scores of places as scores of the sites there, as ``range_filter_by_site`` takes them.

    ``scores`` has (lat, lon, week, species, class_index, score), as ``occurrence_scores`` gives them; ``sites`` (site, lat, lon).
    """
    return sites.select("site", "lat", "lon").join(scores, ["lat", "lon"]).select("site", "week", "species", "class_index", "score")
