"""Sun times as SQL that stays in the JVM; the same text runs on other engines.

Declination and equation of time follow the usual low-order series for a day's noon;
times are good to about a minute below the polar circles. The angles are a choice,
listed in ANCHORS: degrees below the horizon, minutes from such a time, or shares of the day.
"""

from __future__ import annotations

HORIZON = 0.833
# name: (rise or set, degrees below the horizon, minutes more)
ANCHORS = {
    "alos": ("rise", 16.1, 0), "misheyakir": ("rise", 11.5, 0), "netz": ("rise", HORIZON, 0), "shkia": ("set", HORIZON, 0), "tzeis_42": ("set", 7.083, 0),
    "tzeis_72": ("set", HORIZON, 72), "candle_lighting": ("set", HORIZON, -18), "havdalah": ("set", 8.5, 0),
}
# name: (hours of twelve from the day's start, minutes that the day begins before sunrise and ends after sunset)
SHARES = {"sof_zman_shma_gra": (3.0, 0), "sof_zman_shma_mga": (3.0, 72), "sof_zman_tefillah_gra": (4.0, 0), "sof_zman_tefillah_mga": (4.0, 72), "chatzos": (6.0, 0), "mincha_gedolah": (6.5, 0), "plag_mincha": (10.75, 0)}
NAMES = (*ANCHORS, *SHARES)
_DEPTHS = {b: f"h{k}" for k, b in enumerate(sorted({x[1] for x in ANCHORS.values()}))}


def sun_ctes(rows: str, day: str) -> str:
    """CTEs from ``rows`` (a relation with lat and lng) to ``sun``: its columns and ``midnight`` and the minutes after it of each name.

    ``day`` is a DATE expression. A time is null where the sun does not get there, or without a place.
    """
    hour = "CASE WHEN abs({c}) <= 1e0 THEN degrees(acos(least(1e0, greatest(-1e0, {c})))) * 4e0 END"
    cosine = "cos(radians(90e0 + {b}e0)) / (cos(radians(lat)) * cos(dec)) - tan(radians(lat)) * tan(dec)"
    depths = ", ".join(f"{cosine.format(b=b)} AS c{n}" for b, n in _DEPTHS.items())
    hours = ", ".join(f"{hour.format(c='c' + n)} AS {n}" for n in _DEPTHS.values())
    up, down = f"(noon - {_DEPTHS[HORIZON]})", f"(noon + {_DEPTHS[HORIZON]})"
    names = [f"noon {'-' if side == 'rise' else '+'} {_DEPTHS[b]} + {more}e0 AS {n}" for n, (side, b, more) in ANCHORS.items()]
    names += [f"{up} - {more}e0 + ({down} - {up} + {2 * more}e0) * {share / 12!r}e0 AS {n}" for n, (share, more) in SHARES.items()]
    return f"""sun_a AS (SELECT *, 2e0 * pi() / 365e0 * (@doy({day}) - 0.5e0 - lng / 360e0) AS g FROM {rows}),
  sun_b AS (SELECT *, 720e0 - 4e0 * lng - 229.18e0 * (0.000075e0 + 0.001868e0 * cos(g) - 0.032077e0 * sin(g) - 0.014615e0 * cos(2e0 * g) - 0.040849e0 * sin(2e0 * g)) AS noon,
    0.006918e0 - 0.399912e0 * cos(g) + 0.070257e0 * sin(g) - 0.006758e0 * cos(2e0 * g) + 0.000907e0 * sin(2e0 * g) - 0.002697e0 * cos(3e0 * g) + 0.00148e0 * sin(3e0 * g) AS dec FROM sun_a),
  sun_c AS (SELECT *, {depths} FROM sun_b), sun_d AS (SELECT *, {hours} FROM sun_c),
  sun AS (SELECT *, @at({day}, 0, 0) AS midnight, {", ".join(names)} FROM sun_d)"""


def instant(minutes: str) -> str:
    """A time of ``sun`` as a timestamp, to the second."""
    return f"midnight + @seconds(floor(({minutes}) * 60e0 + 0.5e0))"


def of_anchor(column: str, offset: str) -> str:
    """The instant of the anchor that ``column`` names, ``offset`` minutes later; null for unknown names."""
    cases = " ".join(f"WHEN '{n}' THEN {n}" for n in NAMES if n != "havdalah")
    return instant(f"CASE {column} {cases} END + {offset}")
