"""Nearest sites against all pairs."""

import math
import random

from dawnchorus.operators.sites import EARTH_RADIUS_KM, nearest_sites

SITES = "site long, lat double, lon double"
RECORDINGS = "file string, lat double, lon double, site string"


def chord(a, b):
    def xyz(lat, lon):
        lat, lon = math.radians(lat), math.radians(lon)
        return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)

    return math.dist(xyz(*a), xyz(*b))


def plain(place, sites):
    if any(v is None or not math.isfinite(v) for v in place) or abs(place[0]) > 90 or abs(place[1]) > 180:
        return None, None
    d, site = min(((chord(place, s[1:]), s[0]) for s in sites), default=(None, None))
    return site, d and 2 * EARTH_RADIUS_KM * math.asin(d / 2)


def test_nearest_site_anywhere(spark):
    draw = random.Random(2)
    sites = [(i, draw.gauss(55, 3), draw.gauss(10, 4)) for i in range(60)] + [(100, 89.9, 20.0), (101, -89.5, -170.0), (102, 0.2, 179.9)]
    places = [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(80)] + [(draw.gauss(55, 2), draw.gauss(10, 3)) for _ in range(60)]
    places += [(89.99, -160.0), (0.1, -179.9), (sites[3][1], sites[3][2]), (None, 1.0), (float("nan"), 1.0), (95.0, 0.0)]
    rows = [(f"f{i}", *p, "old") for i, p in enumerate(places)] * 2
    got = nearest_sites(spark.createDataFrame(rows, RECORDINGS), spark.createDataFrame([*sites, (9, None, 1.0), (None, 1.0, 1.0)], SITES)).collect()
    assert len(got) == len(rows)
    for r in got:
        site, km = plain((r["lat"], r["lon"]), sites)
        assert r["site"] == site and (km is None or abs(r["distance_km"] - km) < 1e-5)


def test_limits_ties_and_empty_tables(spark):
    here = spark.createDataFrame([("a", 10.0, 10.0, None), ("b", 50.0, 50.0, None)], RECORDINGS)
    sites = spark.createDataFrame([(5, 10.0, 11.0), (4, 10.0, 11.0), (7, -40.0, 0.0)], SITES)
    found = {r["file"]: r["site"] for r in nearest_sites(here, sites, max_km=200.0).collect()}
    assert found == {"a": 4, "b": None}
    assert {r["site"] for r in nearest_sites(here, sites.limit(0)).collect()} == {None}
    assert nearest_sites(here.limit(0), sites).collect() == []
