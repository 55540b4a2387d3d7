"""Table functions for users who write SQL, as SQL themselves: ``create(spark)`` makes them, ``LATERAL`` calls them.

Each is one array of rows, built by expressions and exploded, so a call is a projection of the row that calls it; an
argument that is null gives no row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

EARTH_KM = 6371.0088


def let(value: str, name: str, body: str) -> str:
    """``body`` in which a value has a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_TILE = "named_struct('tlat', CAST({lat} AS BIGINT), 'tlon', pmod(CAST({lon} AS BIGINT) + 180, 360) - 180)"

# One-degree tiles that a box shares an area with.
_BOX = f"""filter(flatten(transform(sequence(floor(south), floor(north)), a -> transform(sequence(floor(west), floor(east)), o -> named_struct('a', a, 'o', o)))),
  c -> least(east, c.o + 1) - greatest(west, c.o) > 0 AND (least(east, c.o + 1) - greatest(west, c.o)) * (least(north, c.a + 1) - greatest(south, c.a)) > 1e-10)"""
TILES_OF_BOX = f"transform({_BOX}, c -> {_TILE.format(lat='c.a', lon='c.o')})"

# One-degree tiles that a straight leg enters, the shorter way round: it is cut at every line of the grid, and the middle of each cut names a tile.
_EAST = "(lon2 + CASE WHEN lon2 - lon1 > 180 THEN -360 WHEN lon2 - lon1 < -180 THEN 360 ELSE 0 END)"
_LINES = "CASE WHEN {a} <> {b} THEN transform(sequence(floor(least({a}, {b})), ceil(greatest({a}, {b}))), k -> (k - {a}) / nullif({b} - {a}, 0D)) ELSE array() END"
_CUTS = f"array_sort(array_distinct(filter(concat(array(0D, 1D), {_LINES.format(a='lat1', b='lat2')}, {_LINES.format(a='lon1', b=_EAST)}), t -> t >= 0 AND t <= 1)))"
_MIDDLES = let(_CUTS, "s", "transform(filter(sequence(1, size(s) - 1), i -> s[i] - s[i-1] > 1e-9), i -> (s[i] + s[i-1]) / 2)")
GRID_WALK = f"array_distinct(transform({_MIDDLES}, m -> {_TILE.format(lat='floor(lat1 + m * (lat2 - lat1))', lon=f'floor(lon1 + m * ({_EAST} - lon1))')}))"

# Points of a great circle, at most step_km apart, the first included, the last not: the start turned towards the tangent that leads to the end.
_ENDS = ", ".join(f"'x{i}', cos(radians(lat{i})) * cos(radians(lon{i})), 'y{i}', cos(radians(lat{i})) * sin(radians(lon{i})), 'z{i}', sin(radians(lat{i}))" for i in (1, 2))
_DOT = "v.x1*v.x2 + v.y1*v.y2 + v.z1*v.z2"
_TANGENT = ", ".join(f"'{c}', v.{c}1, 'e{c}', (v.{c}2 - v.{c}1 * ({_DOT})) / nullif(sin(acos(greatest(-1D, least(1D, {_DOT})))), 0D)" for c in "xyz")
_COUNT = f"CASE WHEN sin(w.a) < 1e-12 THEN 1 ELSE greatest(1, CAST(ceil(w.a * {EARTH_KM}D / step_km) AS INT)) END"
_ON = {c: f"(w.{c} * cos(i * w.a / n) + w.e{c} * sin(i * w.a / n))" for c in "xyz"}
_POINT = f"""named_struct('step', i, 'lat', CASE WHEN i = 0 THEN lat1 ELSE degrees(atan2({_ON['z']}, sqrt({_ON['x']}*{_ON['x']} + {_ON['y']}*{_ON['y']}))) END,
  'lon', CASE WHEN i = 0 THEN lon1 ELSE degrees(atan2({_ON['y']}, {_ON['x']})) END)"""
_PATH = let(_COUNT, "n", f"transform(sequence(0, n - 1), i -> {_POINT})")
GREAT_CIRCLE = let(f"named_struct({_ENDS})", "v", let(f"named_struct({_TANGENT}, 'a', acos(greatest(-1D, least(1D, {_DOT}))))", "w", _PATH))

FUNCTIONS = {
    "tiles_of_box": ("west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE", "tlat BIGINT, tlon BIGINT", TILES_OF_BOX),
    "grid_walk": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "tlat BIGINT, tlon BIGINT", GRID_WALK),
    "great_circle": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, step_km DOUBLE", "step INT, lat DOUBLE, lon DOUBLE", GREAT_CIRCLE),
}


def create(spark: SparkSession) -> None:
    """Make the table functions of this session."""
    for name, (arguments, columns, rows) in FUNCTIONS.items():
        nulls = " OR ".join(f"{a.split()[0]} IS NULL" for a in arguments.split(", "))
        picked = ", ".join(f"r.{c.split()[0]}" for c in columns.split(", "))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN SELECT {picked} FROM (SELECT explode(CASE WHEN {nulls} THEN NULL ELSE {rows} END) AS r)")
