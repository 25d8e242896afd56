"""Zones of points: cells that cover outlines, an equi-join on the cell, rays only in cells on an edge."""

from __future__ import annotations

CELL = 0.25  # degrees of a cell's side


def zones(points: str, cell: float = CELL, outlines: str = "outline") -> str:
    """CTEs to ``zoned``: ``points`` (id, lat, lng) with ``rank`` and ``zone`` of the first outline that holds each, null if none does.

    ``outlines`` has a row a ring (rank, zone, ring, xs, ys): a point is inside where a ray to the east
    crosses an odd number of edges of all rings of a rank, so that holes and several parts are told as well. Of each
    outline the edges are listed by band of latitude, and cells of the grid are whole, if no edge touches them and
    their middle is inside, or on an edge. A point in a whole cell needs no ray; one in a cell on an edge
    is held against the edges of its band. Outlines across the date line come as two parts.
    """
    c = f"{cell!r}e0"
    floor = lambda x: f"CAST(floor(({x}) / {c}) AS INT)"
    at = lambda y: f"CASE WHEN y1 = y2 THEN NULL ELSE x1 + (x2 - x1) * ({y} - y1) / (y2 - y1) END"
    crossed = lambda x, y, e: f"({e}.y1 > {y}) <> ({e}.y2 > {y}) AND {x} < ({e}.x2 - {e}.x1) * ({y} - {e}.y1) / ({e}.y2 - {e}.y1) + {e}.x1"
    odd = lambda edges, x, y: f"@size(@filter({edges}, e, {crossed(x, y, 'e')})) % 2 = 1"
    return f"""corner AS (SELECT rank, xs, ys, @size(xs) AS n, @explode(@upto(@size(xs))) AS k FROM {outlines}),
  edge AS (SELECT rank, @get(xs, k) AS x1, @get(ys, k) AS y1, @get(xs, k % n + 1) AS x2, @get(ys, k % n + 1) AS y2 FROM corner),
  banded AS (SELECT *, @explode(@range({floor('least(y1, y2)')}, {floor('greatest(y1, y2)')})) AS band FROM edge WHERE x1 <> x2 OR y1 <> y2),
  cut AS (SELECT *, {at(f'greatest(least(y1, y2), band * {c})')} AS xa, {at(f'least(greatest(y1, y2), (band + 1) * {c})')} AS xb FROM banded),
  touched AS (SELECT DISTINCT rank, band, col FROM (SELECT rank, band, @explode(@range({floor('least(coalesce(xa, x1), coalesce(xb, x2)) - 1e-9')}, {floor('greatest(coalesce(xa, x1), coalesce(xb, x2)) + 1e-9')})) AS col FROM cut)),
  band_edge AS (SELECT rank, band, @collect(@struct(x1, x1, y1, y1, x2, x2, y2, y2)) AS edges FROM banded WHERE y1 <> y2 GROUP BY rank, band),
  width AS (SELECT rank, band, min(col) AS low, max(col) AS high FROM touched GROUP BY rank, band),
  middle AS (SELECT w.rank, w.band, col FROM (SELECT rank, band, @explode(@range(low, high)) AS col FROM width) w WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.rank = w.rank AND t.band = w.band AND t.col = w.col)),
  cover AS (SELECT m.rank, m.band, m.col, true AS whole FROM middle m JOIN band_edge b ON b.rank = m.rank AND b.band = m.band WHERE {odd('b.edges', f'((m.col + 0.5e0) * {c})', f'((m.band + 0.5e0) * {c})')}
    UNION ALL SELECT rank, band, col, false AS whole FROM touched),
  spot AS (SELECT id, lat, lng, {floor('lat')} AS band, {floor('lng')} AS col FROM {points} WHERE lat IS NOT NULL AND lng IS NOT NULL),
  held AS (SELECT s.id, c.rank FROM spot s JOIN cover c ON c.band = s.band AND c.col = s.col LEFT JOIN band_edge b ON b.rank = c.rank AND b.band = c.band AND NOT c.whole WHERE c.whole OR {odd('b.edges', 's.lng', 's.lat')}),
  winner AS (SELECT id, min(rank) AS rank FROM held GROUP BY id),
  zoned AS (SELECT p.*, w.rank, z.zone FROM {points} p LEFT JOIN winner w ON w.id = p.id LEFT JOIN (SELECT rank, min(zone) AS zone FROM {outlines} GROUP BY rank) z ON z.rank = w.rank)"""


def text(default: str) -> dict[str, str]:
    return {
        "zone_of_point": f"WITH spots AS (SELECT id, lat, lng FROM place), {zones('spots', 0.1)} SELECT id, coalesce(zone, '{default}') AS zone, rank FROM zoned",
        "zone_backfill": f"WITH spots AS (SELECT id, lat, lng FROM place WHERE timezone IS NULL AND lat IS NOT NULL), {zones('spots', 0.1)} SELECT id, coalesce(zone, '{default}') AS zone FROM zoned",
    }
