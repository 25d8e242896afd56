"""What a user of the directory asks: the catalogue's rules with a point, a day, a text or a state of their own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from gnomon.plans import catalog, pages, schedule
from gnomon.plans.dialect import spark_sql, with_relations
from gnomon.sources.model import AS_OF, register

_STATES = ("pending_review", "broken", "awaiting_extraction", "no_good_source", "stale", "unsupported", "active", "archived")


def _anywhere(text: str) -> str:
    """A pattern for LIKE; a backslash stands for itself."""
    return "%" + text.strip().replace("\\", "\\\\") + "%"


class Directory:
    """Queries over tables ``place``, ``source`` and ``rule`` (see ``gnomon.sources.model`` for their columns).

    ``tables`` gives them by name; without, they are mapped from the test tables in ``sf_dir``. ``now``
    is the instant that freshness and the feed are told by, in UTC.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, sf_dir: str | None = None, now: dt.datetime | None = None):
        self.spark, self.mapped = spark, tables is None
        self.now = now or dt.datetime.fromisoformat(AS_OF)
        if tables is None:
            register(spark, sf_dir)
        else:
            for name, rows in tables.items():
                rows.createOrReplaceTempView(name)

    def _run(self, text: str, **values: str) -> DataFrame:
        """``values`` are what users type: they are bound to :name in the statement and never become part of its text."""
        text = catalog.with_extras(text)
        text = spark_sql(with_relations(text) if self.mapped else text)
        return self.spark.sql(text.replace(f"TIMESTAMP '{AS_OF}'", self._at(self.now)), args=values)

    @staticmethod
    def _at(when: dt.datetime) -> str:
        return f"TIMESTAMP '{when:%Y-%m-%d %H:%M:%S}'"

    def _feed(self, lat: float, lng: float, miles: float, day: dt.date | None, travel: bool) -> str:
        day = day or self.now.date()
        return schedule.feed(float(lat), float(lng), schedule.radius(miles), self._at(self.now), f"DATE '{day:%Y-%m-%d}'", travel)

    def nearby(self, lat: float, lng: float, miles: float = 2.0, day: dt.date | None = None, travel: bool = False, tefillah: str | None = None, limit: int = 25) -> DataFrame:
        """What starts near a point, in order: around now, or (``travel``) all around a day.

        Radii are held between 50 and 50,000 metres. ``day`` is the date whose weekday and sun times
        count; by default that of ``now`` in UTC.
        """
        only, values = (" WHERE tefillah = :tefillah", {"tefillah": tefillah}) if tefillah else ("", {})
        return self._run(f"WITH {self._feed(lat, lng, miles, day, travel)} SELECT id, place_id, slug, name, address, tefillah, time_kind, special_kind, metres, starts_at, started, fixed_evening, zone FROM feed{only} ORDER BY {schedule.feed_order(travel)} LIMIT {int(limit)}", **values)

    def nearby_places(self, lat: float, lng: float, miles: float = 2.0, day: dt.date | None = None, travel: bool = False, per_place: int = 2, limit: int = 25) -> DataFrame:
        """The same by place, nearest first, with the first rules of each."""
        return self._run(f"WITH {self._feed(lat, lng, miles, day, travel)} {schedule.groups(per_place, limit)}").orderBy("metres", "place_id", "at_place")

    def search(self, q: str, limit: int = 30) -> DataFrame:
        """Visible places whose name or slug has ``q`` anywhere; ``%`` and ``_`` in it match as in LIKE. A blank text finds none."""
        none = "" if q.strip() else " AND false"
        return self._run(f"WITH {schedule.VISIBLE} SELECT id, slug, name, address FROM visible WHERE (name ILIKE :q OR slug ILIKE :q){none} ORDER BY name, id LIMIT {int(limit)}", q=_anywhere(q))

    def lookup(self, q: str, limit: int = 12) -> DataFrame:
        """Visible places by how well the characters of ``q`` follow one another in name and address."""
        needle = q.strip().lower()
        if not needle:
            return self._run(f"WITH {schedule.VISIBLE} SELECT id, name, address, CAST(0 AS BIGINT) AS score FROM visible WHERE false")
        return self._run(f"WITH {schedule.VISIBLE}, {pages.fuzzy('(SELECT id, name, address FROM visible)', ':needle')} SELECT id, name, address, score FROM fuzzy WHERE score > 0 ORDER BY score DESC, name, id LIMIT {int(limit)}", needle=needle)

    def day(self, slug: str, day: dt.date) -> DataFrame:
        """What is on at a place on a day, by time; the place is found before its rules are read."""
        date = f"DATE '{day:%Y-%m-%d}'"
        place = f"one AS (SELECT p.id, coalesce(p.lat, 0e0) AS lat, coalesce(p.lng, 0e0) AS lng, {schedule.ZONE} AS zone FROM place p WHERE p.slug = :slug)"
        public = f"public_rule AS (SELECT * FROM (SELECT r.*, p.zone, {schedule.WINNER} AS rn FROM rule r JOIN one p ON p.id = r.place_id LEFT JOIN source s ON s.id = r.source_id WHERE {schedule.SHOWN}) WHERE rn = 1)"
        return self._run(f"WITH {place}, {public}, mine AS (SELECT r.* FROM public_rule r WHERE {schedule.applies(date, False)}), {schedule.timed('mine', 'one', date)} SELECT id, tefillah, time_kind, starts_at, {schedule.TIME_LABEL} AS label FROM timed ORDER BY starts_at NULLS LAST, id", slug=slug)

    def listing(self, q: str = "", state: str | None = None, limit: int = 200) -> DataFrame:
        """Places with their state, those of one state alone if named, whose name has ``q``."""
        if state is not None and state not in _STATES:
            raise ValueError(f"state must be one of {', '.join(_STATES)}")
        only = f" AND state = '{state}'" if state else ""
        return self._run(f"WITH {catalog.ADMIN} SELECT a.id, a.slug, p.name, a.status, a.state FROM admin a JOIN place p ON p.id = a.id WHERE p.name ILIKE :q{only} ORDER BY p.name, a.id LIMIT {int(limit)}", q=_anywhere(q))
