"""The filter language: conditions on metadata, combined, compiled to a Column.

Conditions compile against typed columns where a field has one (``typed``) or
against a store's index columns (``indexed``), so that comparisons reach the
Parquet scan, and against a VARIANT otherwise. Every leaf is two-valued by
itself (a missing key is false, also under NOT), so nothing has to be wrapped
around a condition that would hide it from the scan.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import geo, values


class InvalidRequest(ValueError):
    pass


#: Index columns of a field by prefix: its facet text, number, milliseconds, latitude and longitude.
INDEX = {"m": "string", "n": "double", "t": "bigint", "y": "double", "x": "double"}


def index_columns(md: Column, key: str) -> dict[str, Column]:
    """What a store keeps for an indexed field; null where the value is of another kind."""
    lat, lon = (F.try_variant_get(md, values.path(key) + part, "double") for part in (".lat", ".lon"))
    point = geo.is_point(lat, lon)
    made = {"m": values.facet(md, key), "n": values.number(md, key), "t": values.epoch_ms(values.string(md, key)), "y": F.when(point, lat), "x": F.when(point, lon)}
    return {f"{p}_{key}": c for p, c in made.items()}


@dataclass(frozen=True)
class Fields:
    """Where conditions find their fields: typed columns, index columns, then the VARIANT column."""

    typed: Mapping[str, str] = field(default_factory=dict)
    variant: str | None = None
    indexed: frozenset[str] = frozenset()

    def index(self, prefix: str, key: str) -> Column:
        return F.col(f"`{prefix}_{key}`")

    def has(self, key: str) -> Column:
        if key in self.typed:
            return F.col(self.typed[key]).isNotNull()
        if key in self.indexed:
            return self.index("m", key).isNotNull()
        return values.kind(self._md(), key).isNotNull()

    def equals(self, key: str, value: object) -> Column:
        if key in self.typed:
            c = F.col(self.typed[key])
            return c.isNull() if value is None else c.isNotNull() & (c == F.lit(value))
        exact = values.equals(self._md(), key, value)
        if key in self.indexed:
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                n = self.index("n", key)
                return n.isNotNull() & (n == F.lit(float(value)))
            m = self.index("m", key)  # the facet text finds the rows, the value itself tells "null" from null
            return m.isNotNull() & (m == F.lit(value if isinstance(value, str) else json.dumps(value))) & exact
        return exact

    def number(self, key: str) -> Column:
        if key in self.typed:
            return F.col(self.typed[key])
        return self.index("n", key) if key in self.indexed else values.number(self._md(), key)

    def millis(self, key: str) -> Column:
        if key in self.typed:
            return F.unix_millis(F.col(self.typed[key]).cast("timestamp"))
        return self.index("t", key) if key in self.indexed else values.epoch_ms(values.string(self._md(), key))

    def point(self, key: str) -> tuple[Column, Column]:
        if f"{key}.lat" in self.typed:
            return F.col(self.typed[f"{key}.lat"]), F.col(self.typed[f"{key}.lon"])
        if key in self.indexed:
            return self.index("y", key), self.index("x", key)
        v = lambda part: F.try_variant_get(self._md(), values.path(key) + "." + part, "double")
        return v("lat"), v("lon")

    def reaches_scan(self, key: str) -> bool:
        return key in self.typed or f"{key}.lat" in self.typed or key in self.indexed

    def _md(self) -> Column:
        if not self.variant:
            raise InvalidRequest("no such field and no metadata column")
        return F.col(self.variant)


@dataclass(frozen=True)
class Eq:
    key: str
    value: object

    def column(self, at: Fields) -> Column:
        return at.equals(self.key, self.value)


@dataclass(frozen=True)
class Any:
    key: str
    values: tuple

    def column(self, at: Fields) -> Column:
        if self.key in at.typed and self.values and None not in self.values:
            c = F.col(at.typed[self.key])
            return c.isNotNull() & c.isin(*self.values)
        out = F.lit(False)
        for v in self.values:
            out = out | at.equals(self.key, v)
        return out


@dataclass(frozen=True)
class Range:
    key: str
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None

    def column(self, at: Fields) -> Column:
        return _bounds(at.number(self.key), self)


@dataclass(frozen=True)
class DateRange:
    """Bounds are RFC 3339 texts; one that can't be read is refused."""

    key: str
    gt: str | None = None
    gte: str | None = None
    lt: str | None = None
    lte: str | None = None

    def column(self, at: Fields) -> Column:
        own = Range(self.key, *(None if b is None else millis(b) for b in (self.gt, self.gte, self.lt, self.lte)))
        if self.key in at.typed:  # compare the column itself, so that the scan can prune
            c = F.col(at.typed[self.key])
            lit = lambda ms: F.lit(dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).cast("timestamp_ntz")
            return _bounds(c, own, lit)
        return _bounds(at.millis(self.key), own)


@dataclass(frozen=True)
class GeoRadius:
    key: str
    lat: float
    lon: float
    radius_m: float

    def column(self, at: Fields) -> Column:
        lat, lon = at.point(self.key)
        s, w, n, e = geo.radius_box(self.lat, self.lon, self.radius_m)
        near = geo.haversine_m(F.lit(self.lat), F.lit(self.lon), lat, lon) <= self.radius_m
        box = lat.between(s, n)
        if -180 <= w and e <= 180:
            box = box & lon.between(w, e)
        return lat.isNotNull() & lon.isNotNull() & box & geo.is_point(lat, lon) & near


@dataclass(frozen=True)
class GeoBox:
    key: str
    south: float
    west: float
    north: float
    east: float

    def column(self, at: Fields) -> Column:
        lat, lon = at.point(self.key)
        inside = lat.between(self.south, self.north) & lon.between(self.west, self.east)
        return lat.isNotNull() & lon.isNotNull() & inside & geo.is_point(lat, lon)


@dataclass(frozen=True)
class Exists:
    """The key is there; a null value counts."""

    key: str

    def column(self, at: Fields) -> Column:
        return at.has(self.key)


@dataclass(frozen=True)
class Not:
    of: object

    def column(self, at: Fields) -> Column:
        return ~compile_filter(self.of, at)


@dataclass(frozen=True)
class Filter:
    """All of ``must``, one of ``should`` if there are any, none of ``must_not``."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()

    def column(self, at: Fields) -> Column:
        out = F.lit(True)
        for c in self.must:
            out = out & compile_filter(c, at)
        if self.should:
            some = F.lit(False)
            for c in self.should:
                some = some | compile_filter(c, at)
            out = out & some
        for c in self.must_not:
            out = out & ~compile_filter(c, at)
        return out


def millis(text: str) -> int:
    try:
        t = dt.datetime.fromisoformat(text.strip().upper().replace("Z", "+00:00"))
    except ValueError as e:
        raise InvalidRequest(f"not an RFC 3339 timestamp: {text!r}") from e
    if t.tzinfo is None:
        raise InvalidRequest(f"no offset in timestamp: {text!r}")
    return int(t.timestamp() * 1000)


def _bounds(c: Column, r: object, lit=F.lit) -> Column:
    out = c.isNotNull()
    for name, test in (("gt", c.__gt__), ("gte", c.__ge__), ("lt", c.__lt__), ("lte", c.__le__)):
        if getattr(r, name) is not None:
            out = out & test(lit(getattr(r, name)))
    return out


def compile_filter(condition: object, at: Fields) -> Column:
    """A Column that is true or false, never null."""
    return condition.column(at)


def keys_of(condition: object) -> set[str]:
    """The fields a condition reads."""
    if isinstance(condition, Filter):
        return set().union(*(keys_of(c) for c in (*condition.must, *condition.should, *condition.must_not)), set())
    if isinstance(condition, Not):
        return keys_of(condition.of)
    return {condition.key}


def explain_filter(condition: object, at: Fields) -> dict[str, bool]:
    """Which of its fields a scan can prune by."""
    return {k: at.reaches_scan(k) for k in sorted(keys_of(condition))}


_KINDS = {"eq": Eq, "any": Any, "range": Range, "date_range": DateRange, "geo_radius": GeoRadius, "geo_box": GeoBox, "exists": Exists}


def from_json(body: Mapping) -> object:
    """{"must": [...], "should": [...], "must_not": [...]} or one condition {"type": ..., fields}."""
    if "type" in body:
        rest = {k: v for k, v in body.items() if k != "type"}
        if "values" in rest:
            rest["values"] = tuple(rest["values"])
        try:
            return _KINDS[body["type"]](**rest)
        except (KeyError, TypeError) as e:
            raise InvalidRequest(f"bad condition: {body}") from e
    return Filter(*(tuple(from_json(c) for c in body.get(k, ())) for k in ("must", "should", "must_not")))
