"""Distances, boxes and coordinate repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    half = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


#: Semi-major axis (metres) and flattening of the WGS84 spheroid.
MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563


Fields = dict[str, Column]
Named = Callable[[str], Column]


def _place(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Fields:
    """Difference of longitudes, and sines and cosines of both latitudes on the auxiliary sphere."""
    apart = lng2 - lng1
    across = F.radians(F.when(apart > 180, apart - 360).when(apart < -180, apart + 360).otherwise(apart).cast("double"))
    u1, u2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(y))) for y in (lat1, lat2))
    return {"L": across, "s1": F.sin(u1), "c1": F.cos(u1), "s2": F.sin(u2), "c2": F.cos(u2)}


def _arcs(v: Named) -> Fields:
    across, up = v("c2") * F.sin(v("lam")), v("c1") * v("s2") - v("s1") * v("c2") * F.cos(v("lam"))
    return {"sin": F.sqrt(across * across + up * up), "cos": v("s1") * v("s2") + v("c1") * v("c2") * F.cos(v("lam")), "cross": v("c1") * across}


def _azimuth(v: Named) -> Fields:
    sina = F.when(v("sin") == 0, 0.0).otherwise(v("cross") / v("sin"))  # equal points have no azimuth
    return {"arc": F.atan2(v("sin"), v("cos")), "sina": sina, "cos2a": 1 - sina * sina}


def _middle(v: Named) -> Fields:
    mid = F.when(v("cos2a") <= 1e-15, 0.0).otherwise(v("cos") - 2 * v("s1") * v("s2") / v("cos2a"))  # along the equator
    return {"mid": mid, "c": FLATTENING / 16 * v("cos2a") * (4 + FLATTENING * (4 - 3 * v("cos2a")))}


def _longitude(v: Named) -> Fields:
    lam = v("L") + (1 - v("c")) * FLATTENING * v("sina") * (v("arc") + v("c") * v("sin") * (v("mid") + v("c") * v("cos") * (2 * v("mid") * v("mid") - 1)))
    return {"moved": F.abs(lam - v("lam")), "lam": lam}


def _series(v: Named) -> Fields:
    minor = MAJOR_M * (1 - FLATTENING)
    u = v("cos2a") * (MAJOR_M**2 - minor**2) / minor**2
    return {"a": minor * (1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))), "b": u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))}


def _length(v: Named) -> Column:
    sin, cos, mid, b = v("sin"), v("cos"), v("mid"), v("b")
    bend = b * sin * (mid + b / 4 * (cos * (2 * mid * mid - 1) - b / 6 * mid * (4 * sin * sin - 3) * (4 * mid * mid - 3)))
    return F.when((v("moved") <= 1e-12) & (F.abs(v("lam")) <= 3.15), v("a") * (v("arc") - bend))


ROUND = (_arcs, _azimuth, _middle, _longitude)


def geodesic_metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column, rounds: int = 40) -> Column:
    """Length in metres of the shortest line on the WGS84 spheroid, to less than a millimetre.

    The difference of longitudes on the auxiliary sphere is improved for at most
    ``rounds`` rounds, and no longer than it moves by more than 1e-12; a few
    suffice but near antipodes.  Null if it does not settle (within about half
    a degree of the antipode), or if a coordinate is missing.  This form is
    evaluated as a fold over the rounds; ``with_geodesic`` compiles, for near points.
    """

    def bound(fields: Fields, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])), body), F.lit(0))

    place = ("L", "s1", "c1", "s2", "c2")
    names = (*place, "lam", "moved", "sin", "cos", "arc", "cos2a", "mid")

    def advance(held: Fields, layers: tuple) -> Column:
        if not layers:
            return F.struct(*[held[n].alias(n) for n in names])
        fields = held | layers[0](held.__getitem__)
        return bound(fields, lambda s: advance({n: s[n] for n in fields}, layers[1:]))

    def settled(g: Column) -> Column:
        start = dict.fromkeys(names, F.lit(0.0)) | {n: g[n] for n in place} | {"lam": g["L"], "moved": F.lit(1.0)}
        step = lambda s, _: F.when(s["moved"] > 1e-12, advance({n: s[n] for n in names}, ROUND)).otherwise(s)
        end = lambda s: bound({n: s[n] for n in names} | _series(s.__getitem__), lambda t: _length(t.__getitem__))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(*[c.alias(n) for n, c in start.items()]), step, end)

    known = lat1.isNotNull() & lng1.isNotNull() & lat2.isNotNull() & lng2.isNotNull()
    return F.when(known, bound(_place(lat1, lng1, lat2, lng2), settled))


def with_geodesic(df: DataFrame, lat1: str, lng1: str, lat2: str, lng2: str, name: str, rounds: int = 6) -> DataFrame:
    """``df`` with ``geodesic_metres`` of four of its columns as ``name``, every step a projection that Spark compiles.

    Six rounds settle lines up to a quarter of the globe; a line that they do not settle is null.
    """
    mark = "_geo_"
    held = lambda n: F.col(mark + n)
    names = df.columns

    def add(rows: DataFrame, fields: Fields) -> DataFrame:
        return rows.withColumns({mark + n: c for n, c in fields.items()})

    rows = add(df, _place(F.col(lat1), F.col(lng1), F.col(lat2), F.col(lng2)))
    rows = add(rows, {"lam": held("L")})
    for _ in range(rounds):
        for layer in ROUND:
            rows = add(rows, layer(held))
    rows = add(rows, _series(held))
    # generated, so that a later filter on it is not moved below the steps, which would spell them out
    return rows.select(*[f"`{c}`" for c in names], F.explode(F.array(_length(held))).alias(name))


#: The spheroid's radii of curvature lie between these, as multiples of the sphere's radius; so do lengths
#: of lines between two places, which are sums of small steps.
LEAST_STRETCH = MAJOR_M * (1 - FLATTENING) ** 2 / (EARTH_KM * 1000)
MOST_STRETCH = MAJOR_M / (1 - FLATTENING) / (EARTH_KM * 1000)


def rounded(length: Column, places: int) -> Column:
    """A length, which is not negative, rounded half up; unlike ``round``, it needs no decimal number a row, which for pairs costs more than their length."""
    return F.floor(length * 10**places + 0.5) / 10**places


#: Up to so many metres the straight line between two places tells the line on the spheroid to 1e-7 metres.
SHORT_M = 2000.0


def spheroid_place(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """Metres from the spheroid's centre, along its three axes."""
    y, x, e2 = F.radians(lat), F.radians(lng), FLATTENING * (2 - FLATTENING)
    normal = MAJOR_M / F.sqrt(1 - e2 * F.sin(y) * F.sin(y))
    return normal * F.cos(y) * F.cos(x), normal * F.cos(y) * F.sin(x), normal * (1 - e2) * F.sin(y)


def short_metres(chord: Column) -> Column:
    """``geodesic_metres`` of two places a straight line of up to ``SHORT_M`` apart.

    The line on the spheroid is longer by a 24th of the line's cube over the square of its radius of
    curvature, 8e-6 metres at most; that this radius is taken as the sphere's adds an error of about a hundredth of it.
    """
    return chord * (1 + chord * chord / (24 * (EARTH_KM * 1000) ** 2))


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


#: Metres of a degree in planar distances, and the closeness of points less than so many metres apart.
PLANAR_METRES = 111_320
CLOSENESS = ((100, 1.0), (500, 0.8), (1000, 0.5))


def planar_closeness(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """1, 0.8, 0.5 or 0 for points less than 100, 500, 1000 metres apart or further; degrees of longitude shrink with |lat1| / 90.

    A missing or zero coordinate is close to nothing.
    """
    dy = F.abs(lat1 - lat2) * PLANAR_METRES
    dx = F.abs(lng1 - lng2) * PLANAR_METRES * F.abs(lat1) / 90
    metres = F.sqrt(dx * dx + dy * dy)
    known = F.coalesce((lat1 != 0) & (lng1 != 0) & (lat2 != 0) & (lng2 != 0), F.lit(False))
    chain = F.when(~known, 0.0)
    for limit, value in CLOSENESS:
        chain = chain.when(metres < limit, value)
    return chain.otherwise(0.0)


def repair_coordinates(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """struct(lat, lng, how): in range, swapped, scaled by powers of ten, signs, or left as it is.

    The first power of ten that brings a latitude into the box is tried with
    every power for the longitude; then one power for both; then the signs.
    """
    lat, lng = lat.try_cast("double"), lng.try_cast("double")

    def ok(y: Column, x: Column) -> Column:
        return F.coalesce(in_box(y, x, box), F.lit(False))

    def result(y: Column, x: Column, how: str) -> Column:
        return F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lng"), F.lit(how).alias("how"))

    powers = F.array(*[F.lit(float(10**k)) for k in range(16, 1, -1)])
    lat_power = F.get(F.filter(powers, lambda p: (lat / p).between(box[0], box[1])), F.lit(0))
    lng_power = F.get(F.filter(powers, lambda p: (lng / p).between(box[2], box[3])), F.lit(0))
    common = F.get(F.filter(F.array(*[F.lit(float(10**k)) for k in range(16, 9, -1)]), lambda p: ok(lat / p, lng / p)), F.lit(0))
    large = (F.abs(lat) > 100) | (F.abs(lng) > 100)
    null = F.lit(None)
    return (
        F.when(lat.isNull() | lng.isNull() | (lat == 0) | (lng == 0), result(null, null, "vacias"))
        .when(ok(lat, lng), result(lat, lng, "validas"))
        .when(ok(lng, lat), result(lng, lat, "invertidas"))
        .when(large & lat_power.isNotNull() & lng_power.isNotNull(), result(lat / lat_power, lng / lng_power, "normalizadas"))
        .when((F.abs(lat) > 1000) & (F.abs(lng) > 1000) & common.isNotNull(), result(lat / common, lng / common, "divididas"))
        .when(ok(-F.abs(lat), -F.abs(lng)), result(-F.abs(lat), -F.abs(lng), "signos"))
        .otherwise(result(lat, lng, "fuera"))
    )


def parse_point(text: Column) -> Column:
    """struct(lat, lng) of "lat, lng"; null unless both parts are numbers."""
    parts = F.split(text, ",")
    lat, lng = F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")
    return F.when(lat.isNotNull() & lng.isNotNull() & (F.size(parts) == 2), F.struct(lat.alias("lat"), lng.alias("lng")))
