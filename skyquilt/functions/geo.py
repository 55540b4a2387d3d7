"""Geographic scalar functions: column expressions, no Python in the tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM, MERCATOR_M, TEXTURE_TILES = 6371.0088, 6378137.0, 16
KM_PER_DEGREE = math.pi * EARTH_KM / 180
RINGS_ZL16_KM = {3: 81.4, 2: 42.9, 1: 23.7, 0: 13.6}
MARGIN, LOAD_LEVEL, LOAD_KM, MIN_LEVEL, MAX_SCALE, WIDTH_PX, FOV_DEG = 1.11, 4, 230.0, -1, 4.0, 2704.0, 65.0
TROPICS = 23.44


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _north(lat) -> Column:
    """The mercator ordinate of a latitude, in half turns."""
    return F.log(F.tan((c(lat) + 90.0) * math.pi / 360.0)) / math.pi


def tile_xy(lat, lon, zl) -> tuple[Column, Column]:
    scale = F.pow(F.lit(2.0), c(zl) - 1)
    return (c(lon) / 180.0 + 1.0) * scale, (1.0 - _north(lat)) * scale


def to_pixel(lat, lon, zl) -> tuple[Column, Column]:
    """Whole pixels, rounded half to even."""
    scale = F.pow(F.lit(2.0), c(zl) + 7)
    return tuple(F.rint(v * scale).cast("long") for v in (c(lon) / 180.0 + 1.0, 1.0 - _north(lat)))


def pixel_to_latlon(px, py, zl) -> tuple[Column, Column]:
    return tile_corner(c(px) / 256.0, c(py) / 256.0, zl)


def gtile(lat, lon, zl) -> tuple[Column, Column]:
    return tuple(F.floor(p / 256.0).cast("long") for p in to_pixel(lat, lon, zl))


def texture_at(lat, lon, zl) -> tuple[Column, Column]:
    """The 16-tile texture of a point; truncates toward zero."""
    scale = F.pow(F.lit(2.0), c(zl) - 5)
    return tuple((v * scale).cast("long") * TEXTURE_TILES for v in (c(lon) / 180.0 + 1.0, 1.0 - _north(lat)))


def tile_corner(x, y, zl) -> tuple[Column, Column]:
    """(lat, lon) of a tile's north-west corner."""
    half = F.pow(F.lit(2.0), c(zl) - 1)
    return F.atan(F.exp((1.0 - c(y) / half) * math.pi)) * (360.0 / math.pi) - 90.0, (c(x) / half - 1.0) * 180.0


def texture_bbox(x, y, zl) -> Column:
    north, west = tile_corner(x, y, zl)
    south, east = tile_corner(c(x) + TEXTURE_TILES, c(y) + TEXTURE_TILES, zl)
    return F.struct(south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east"))


def quadkey(x, y, zl) -> Column:
    """One base-4 digit a level: the bits of x and y interleaved."""
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), c(zl).cast("int")), lambda i: _digit(x, y, zl, i)))


def _digit(x, y, zl, i) -> Column:
    size = F.pow(F.lit(2.0), c(zl) - i)
    bit = lambda v: F.pmod(F.floor(c(v) / size), F.lit(2))
    return (bit(x) + 2 * bit(y)).cast("long").cast("string")


def quadkey_xy(key) -> tuple[Column, Column]:
    """x and y of a quadkey."""
    digits = F.transform(F.split(c(key), ""), lambda d: F.coalesce(F.when(d != "", d).cast("long"), F.lit(0).cast("long")))
    x = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 2 + d % 2)
    y = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 2 + F.floor(d / 2))
    return x, y


def texture_name(x, y, provider, zl) -> Column:
    return F.concat(c(y).cast("string"), F.lit("_"), c(x).cast("string"), F.lit("_"), c(provider), c(zl).cast("string"))


def parse_texture_name(name) -> Column:
    """struct(y, x, provider, zl), null for what is no texture's name.

    The last two digits are the level from 10 to 22, else the last digit alone; y and x are multiples of 16.
    """
    stem = F.regexp_replace(F.regexp_replace(c(name), r"^.*/", ""), r"\..*$", "")
    two = F.regexp_extract(stem, r"(\d{2})$", 1)
    is_two = (two != "") & F.coalesce(F.when(two != "", two).cast("int").between(10, 22), F.lit(False))
    cut = F.when(is_two, 2).otherwise(1)
    rest = F.regexp_extract(stem, r"^\d+_\d+_(.*)$", 1)
    whole = lambda i: F.regexp_extract(stem, r"^(\d+)_(\d+)_", i).cast("long")
    good = stem.rlike(r"^\d+_\d+_.*\D\d{1,2}$|^\d+_\d+_.+\d$") & (whole(1) % 16 == 0) & (whole(2) % 16 == 0) & (F.length(rest) > cut)
    own = F.struct(
        whole(1).alias("y"), whole(2).alias("x"),
        rest.substr(F.lit(1), F.length(rest) - cut).alias("provider"), F.right(stem, cut.cast("int")).cast("int").alias("zl"),
    )
    return F.when(good, own)


def pixel_size_m(lat, zl) -> Column:
    return 2 * math.pi * MERCATOR_M * F.cos(F.radians(c(lat))) / F.pow(F.lit(2.0), c(zl) + 8)


def st_coord(lat, lon, x, y, zl) -> tuple[Column, Column]:
    scale = F.pow(F.lit(2.0), c(zl) - 5)
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return clamp((c(lon) / 180.0 + 1.0) * scale - F.floor(c(x) / 16)), clamp(1.0 - ((1.0 - _north(lat)) * scale - F.floor(c(y) / 16)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    h = F.pow(F.sin(F.radians(c(lat2) - c(lat1)) / 2), 2) + F.cos(F.radians(c(lat1))) * F.cos(F.radians(c(lat2))) * F.pow(F.sin(F.radians(c(lon2) - c(lon1)) / 2), 2)
    return F.when(h.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    a, b, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    angle = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.pmod(F.degrees(angle) + 360.0, F.lit(360.0))


def angle_diff(a, b) -> Column:
    d = F.pmod(F.abs(c(a) - c(b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def lon_wrap(lon) -> Column:
    """Into [-180, 180)."""
    return F.pmod(c(lon) + 180, F.lit(360)) - 180


def lon_unwrap(lon_from, lon_to) -> Column:
    """``lon_to`` by whole turns into half a turn round ``lon_from``; both in [-180, 180]."""
    d = c(lon_to) - c(lon_from)
    return c(lon_to) + F.when(d > 180.0, -360.0).when(d < -180.0, 360.0).otherwise(0.0)


def dead_reckon(lat, lon, track, speed_ms, minutes) -> tuple[Column, Column]:
    km = F.greatest(c(speed_ms), F.lit(0.0)) * c(minutes) * 60.0 / 1000.0
    t = F.radians(c(track))
    return c(lat) + km * F.cos(t) / KM_PER_DEGREE, c(lon) + km * F.sin(t) / (KM_PER_DEGREE * F.greatest(F.lit(0.01), F.cos(F.radians(c(lat)))))


def metres_per_degree(lat) -> tuple[Column, Column]:
    """Of latitude and of longitude."""
    per = math.pi * MERCATOR_M / 180
    return F.lit(per), per * F.cos(F.radians(c(lat)))


def tile_name(lat, lon) -> Column:
    return F.format_string("%+03d%+04d", F.floor(c(lat)).cast("int"), F.floor(c(lon)).cast("int"))


def hemisphere_name(lat, lon) -> Column:
    a, b = F.floor(c(lat)).cast("int"), F.floor(c(lon)).cast("int")
    return F.format_string("%s%02d%s%03d", F.when(a >= 0, "N").otherwise("S"), F.abs(a), F.when(b >= 0, "E").otherwise("W"), F.abs(b))


def ten_degree_name(lat, lon) -> Column:
    return F.format_string("%+03d%+04d", (F.floor(c(lat) / 10) * 10).cast("int"), (F.floor(c(lon) / 10) * 10).cast("int"))


BANDS = "CDEFGHJKLMNPQRSTUVWX"


def grid_zone(lat, lon) -> Column:
    """Six-degree zone number and eight-degree band letter, null beyond 80 degrees."""
    zone = F.floor((c(lon) + 180) / 6).cast("int") + 1
    band = F.substring(F.lit(BANDS), (F.floor((c(lat) + 80) / 8) + 1).cast("int"), F.lit(1))
    return F.when((c(lat) >= -80) & (c(lat) < 80), F.concat(F.format_string("%02d", zone), band))


def tile_url(template, x, y, zl) -> Column:
    """{x} {y} {-y} {zoom} {quadkey} and {switch:a,b,c}, the last by (x + y) modulo its choices."""
    servers = F.split(F.regexp_extract(c(template), r"\{switch:([^}]*)\}", 1), ",")
    picked = F.trim(F.element_at(servers, (F.pmod(c(x) + c(y), F.size(servers)) + 1).cast("int")))
    url = F.regexp_replace(c(template), r"\{switch:[^}]*\}", "{}")
    flipped = (F.pow(F.lit(2.0), c(zl)) - 1 - c(y)).cast("long")
    for mark, value in (("{}", picked), ("{x}", c(x)), ("{y}", c(y)), ("{-y}", flipped), ("{zoom}", c(zl)), ("{quadkey}", quadkey(x, y, zl))):
        url = F.replace(url, F.lit(mark), value.cast("string"))
    return url


def ring_area_ha(lats, lons) -> Column:
    """Shoelace area of one ring, scaled by the cosine of its mean latitude, to a tenth of a hectare."""
    n = F.size(c(lats))
    nxt = lambda a: F.concat(F.slice(c(a), F.lit(2), n - 1), F.slice(c(a), F.lit(1), F.lit(1)))
    parts = F.zip_with(F.arrays_zip(c(lons).alias("a"), c(lats).alias("b")), F.arrays_zip(nxt(lons).alias("a"), nxt(lats).alias("b")), lambda p, q: p["a"] * q["b"] - q["a"] * p["b"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return F.when(n >= 3, F.abs(total(parts)) / 2 * F.cos(F.radians(total(c(lats)) / n)) * 111_195.0 * 111_195.0 / 10_000).otherwise(0.0)


def sun_height(day, solar, lat) -> Column:
    d = F.radians(-23.44 * F.cos(F.radians(360.0 / 365.0 * (c(day) + 10))))
    h, p = F.radians(15.0 * (c(solar) - 12.0)), F.radians(c(lat))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(p) * F.sin(d) + F.cos(p) * F.cos(d) * F.cos(h)))))


def is_night(day, solar, lat, ahead_h: float = 1.0, unsure_h: float = 0.0) -> Column:
    return F.least(*(sun_height(day, c(solar) + h, lat) for h in (-unsure_h, 0.0, ahead_h))) < 0.0


def season_on(day, lat, year: int) -> Column:
    md = F.date_format(F.date_add(F.make_date(F.lit(year), F.lit(1), F.lit(1)), (c(day) - 1).cast("int")), "MMdd")
    north = F.when(md.between("0320", "0620"), 0).when(md.between("0621", "0922"), 1).when(md.between("0923", "1220"), 2).otherwise(3)
    turned = F.when(c(lat) >= 0, north).otherwise((north + 2) % 4)
    names = F.array(*map(F.lit, ("spring", "summer", "autumn", "winter")))
    return F.when(F.abs(c(lat)) < TROPICS, "summer").otherwise(F.element_at(names, turned + 1))


def road_class(subtype) -> Column:
    """struct(name, rural) or null."""
    s = c(subtype)
    family = F.floor(s / 10)
    name = F.when(s.between(100, 119), "motorway").when(s.between(120, 129), "motorway_link").when(family.isin(1, 2), "primary").when(family.isin(3, 4), "secondary").when(family.isin(5, 6, 7), "residential")
    return F.when(name.isNotNull(), F.struct(name.alias("name"), ((s < 100) & (s % 10 == 9)).alias("rural")))


def ring_km(level: int, zoom) -> Column:
    return RINGS_ZL16_KM[level] * F.pow(F.lit(2.0), 16 - c(zoom))


def top_level_for(distance_km, zoom, finest, margin: float = MARGIN) -> Column:
    level = F.lit(None).cast("int")
    for n in range(LOAD_LEVEL - 1, -1, -1):
        level = F.when((c(distance_km) <= ring_km(n, zoom) * margin) & (c(finest) <= n), n).otherwise(level)
    return F.coalesce(level, F.lit(LOAD_LEVEL))


def file_top(zoom, max_zoom) -> Column:
    return F.greatest(F.lit(MIN_LEVEL), F.least(F.lit(LOAD_LEVEL), c(zoom) - c(max_zoom)))


def screen_scale(width_px, fov_deg) -> Column:
    scale = c(width_px) / WIDTH_PX * (math.tan(math.radians(FOV_DEG / 2)) / F.tan(F.radians(c(fov_deg) / 2)))
    known = c(width_px).isNotNull() & (c(width_px) != 0) & c(fov_deg).between(1.0, 170.0)
    return F.when(known, F.least(F.lit(MAX_SCALE), F.greatest(F.lit(1.0), scale))).otherwise(1.0)


def reach_needed(along_km, height_km, scale) -> Column:
    needs = [F.lit(0.0)]
    for ring in RINGS_ZL16_KM.values():
        r = ring * c(scale)
        needs.append(F.when(c(height_km) < r, c(along_km) + F.sqrt(r * r - c(height_km) * c(height_km)) - r * MARGIN).otherwise(0.0))
    return F.greatest(*needs)


def level_bytes(side, block: int = 16) -> Column:
    """Bytes of a square block-compressed level."""
    return F.pow(F.floor((c(side) + 3) / 4), 2).cast("long") * block


def file_bytes(side, block: int = 16, header: int = 128, disk: int = 4096) -> Column:
    """Bytes of a texture with all levels down to one pixel, rounded up to disk blocks."""
    levels = F.sequence(F.lit(0), F.floor(F.log2(c(side))).cast("int"))
    body = F.aggregate(levels, F.lit(0).cast("long"), lambda a, k: a + level_bytes(F.greatest(F.lit(1.0), F.floor(c(side) / F.pow(F.lit(2.0), k))), block))
    return (F.ceil((body + header) / disk) * disk).cast("long")


def triangle_area_m2(lat1, lon1, lat2, lon2, lat3, lon3) -> Column:
    per = math.pi * MERCATOR_M / 180
    k = F.cos(F.radians((c(lat1) + c(lat2) + c(lat3)) / 3))
    cross = (c(lon2) - c(lon1)) * (c(lat3) - c(lat1)) - (c(lon3) - c(lon1)) * (c(lat2) - c(lat1))
    return F.abs(cross) / 2 * per * per * k


def triangle_type(attr, bits: int = 7, masks_inland: bool = False) -> Column:
    """0 land, 1 inland water, 2 sea."""
    t = c(attr).cast("long").bitwiseAND(F.lit(bits).cast("long"))
    return F.when(t == 0, 0).when((t > 1) | F.lit(masks_inland), 2).otherwise(1)


def classify_triangle(attr, water: int = 1, sea: int = 2, sea_equiv: int = 4, interp: int = 8) -> Column:
    a = c(attr).cast("long")
    has = lambda b: a.bitwiseAND(F.lit(b).cast("long")) != 0
    return F.when(a % 10 == 0, "skip").when(a >= interp, "interp").when(has(sea), "sea").when(has(water) | has(sea_equiv), "water").otherwise("land")


def depth_ratio(bathy, is_coast, ratio) -> Column:
    r = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 10.0 * c(ratio) * c(bathy) / 255.0))
    return F.when(c(is_coast), 0).otherwise((65535 * r).cast("int"))


def morton(qx, qy, bits: int = 24) -> Column:
    """Bits of qx at even places, of qy at odd ones."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out + F.shiftleft(F.shiftright(c(qx), i).bitwiseAND(F.lit(1).cast("long")), 2 * i) + F.shiftleft(F.shiftright(c(qy), i).bitwiseAND(F.lit(1).cast("long")), 2 * i + 1)
    return out


def quantize24(v, low: float, high: float) -> Column:
    top = float((1 << 24) - 1)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(top), (c(v) - low) / (high - low) * top))).cast("long")


def point_in_ring(x, y, xs, ys) -> Column:
    """Even-odd rule over the vertex arrays ``xs`` and ``ys``; a side belongs to the ring but for its lower end, so a level side does not.

    A side that climbs from its lower to its upper end passes a point by the shares of its width and its height that
    lie beyond and below the point: together 1 on the side itself.
    """
    n = F.size(c(xs))

    def side(i):
        j = (i + 1) % n
        up = F.get(c(ys), i) < F.get(c(ys), j)
        at = lambda v, low: F.when(up == F.lit(low), F.get(c(v), i)).otherwise(F.get(c(v), j))
        x1, y1, x2, y2 = at(xs, True), at(ys, True), at(xs, False), at(ys, False)
        part = (c(x) - x2) / F.nullif(x1 - x2, F.lit(0.0)) + (c(y) - y1) / F.nullif(y2 - y1, F.lit(0.0))
        # negative beyond the side, zero on it, positive before it
        before = F.when(x1 == x2, x1 - c(x)).when(x1 > x2, 1 - part).otherwise(part - 1)
        return F.when((y1 < c(y)) & (c(y) <= y2), F.signum(before))

    sides = F.filter(F.transform(F.sequence(F.lit(0), n - 1), side), lambda v: v.isNotNull())
    return F.exists(sides, lambda v: v == 0) | (F.size(F.filter(sides, lambda v: v > 0)) % 2 == 1)


def camera_position(lat, lon, east_m, south_m) -> tuple[Column, Column]:
    k = KM_PER_DEGREE * 1000.0
    return c(lat) - c(south_m) / k, c(lon) + c(east_m) / (k * F.greatest(F.lit(0.01), F.cos(F.radians(c(lat)))))
