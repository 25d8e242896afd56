"""Zones of points against rays over all edges."""

from __future__ import annotations

import json
import random

from gnomon.plans import zones
from gnomon.plans.catalog import with_extras
from gnomon.plans.dialect import spark_sql
from gnomon.sources import io

SCHEMA = "rank int, zone string, ring int, xs array<double>, ys array<double>"


def inside(rings, x, y):
    odd = False
    for xs, ys in rings:
        for k in range(len(xs)):
            x1, y1, x2, y2 = xs[k], ys[k], xs[(k + 1) % len(xs)], ys[(k + 1) % len(xs)]
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def found(spark, outlines, points, cell):
    outlines.createOrReplaceTempView("outline")
    points.createOrReplaceTempView("spots")
    return spark.sql(spark_sql(with_extras(f"WITH {zones.zones('spots', cell)} SELECT id, rank, zone FROM zoned")))


def test_zones_of_points(spark):
    r = random.Random(4)
    rings = []
    for rank in range(1, 9):
        x, y, size = r.uniform(-2, 2), r.uniform(-1, 1), r.uniform(0.1, 1.5)
        rings.append((rank, f"z{rank}", 0, *(list(t) for t in zip(*[(x + size * r.uniform(0.3, 1) * dx, y + size * r.uniform(0.3, 1) * dy) for dx, dy in ((1, 0), (0.7, 0.7), (0, 1), (-0.7, 0.7), (-1, 0), (-0.7, -0.7), (0, -1), (0.7, -0.7))], strict=True))))
        if rank % 2:
            rings.append((rank, f"z{rank}", 1, [x - size / 5, x + size / 5, x + size / 5, x - size / 5, x - size / 5], [y - size / 5, y - size / 5, y + size / 5, y + size / 5, y - size / 5]))
        if rank % 3 == 0:
            rings.append((rank, f"z{rank}", 2, [3.0, 3.25, 3.25, 3.0], [rank / 4, rank / 4, rank / 4 + 0.25, rank / 4 + 0.25]))
    points = [(k, r.uniform(-2.5, 2.5), r.uniform(-3, 3.5)) for k in range(1500)] + [(2000 + k, k % 20 / 8 - 1, k // 20 / 8 - 2) for k in range(700)] + [(3000, None, 1.0), (3001, 1.0, None)]
    want = {}
    for k, y, x in points:
        held = [rank for rank in range(1, 9) if y is not None and x is not None and inside([t[3:] for t in rings if t[0] == rank], x, y)]
        want[k] = min(held) if held else None
    assert len(set(want.values())) > 6
    for cell in (0.1, 0.25, 1.0):
        got = found(spark, spark.createDataFrame(rings, SCHEMA), spark.createDataFrame(points, "id int, lat double, lng double"), cell)
        assert {r.id: r.rank for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    empty = found(spark, spark.createDataFrame([], SCHEMA), spark.createDataFrame(points, "id int, lat double, lng double"), 0.25)
    assert {r.rank for r in empty.collect()} == {None}


def test_outlines_of_a_file(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    far = [[9, 9], [10, 9], [10, 10], [9, 9]]
    features = [
        {"type": "Feature", "properties": {"tzid": "A/One"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square, hole], [far]]}},
        {"type": "Feature", "properties": {"tzid": "No"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"tzid": "B/Two"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
    ]
    (tmp_path / "zones.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "zones.geojsonl").write_text("\n".join(map(json.dumps, features)))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 9.2, 9.5), (4, 7.0, 7.0)], "id int, lat double, lng double")
    for name in ("zones.json", "zones.geojsonl"):
        outlines = io.outlines(spark, str(tmp_path / name))
        assert outlines.count() == 4
        assert {r.id: r.zone for r in found(spark, outlines, points, 0.25).collect()} == {1: "A/One", 2: "B/Two", 3: "A/One", 4: None}
