"""Distances on the spheroid, and scans of a table kept in Morton order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from predio.functions.geo import FLATTENING, MAJOR_M, rounded, with_geodesic
from predio.operators import morton
from predio.operators.graph import scratch_folder
from predio.operators.spatial import geodesic_join
from predio.plans.registry import haversine, query
from predio.schema import BOX_RAW
from predio.sources.views import propiedades, servicios

_F, _A = f"{FLATTENING!r}::DOUBLE", f"{MAJOR_M!r}::DOUBLE"
_B = f"({_A} * (1 - {_F}))"


def inverse(rows: str, keep: str) -> str:
    """Tables g0, g1, ..., geo: ``keep`` of ``rows`` (lat, lng, lat2, lng2) and the length ``metros``, by six rounds."""
    out = [f"""g0 AS (SELECT {keep}, radians(lng2 - lng) AS dl, dl AS lam, atan((1 - {_F}) * tan(radians(lat))) AS u1, atan((1 - {_F}) * tan(radians(lat2))) AS u2,
      sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, 0::DOUBLE AS ss, 0::DOUBLE AS cs, 0::DOUBLE AS arc, 0::DOUBLE AS ca, 0::DOUBLE AS cm FROM {rows})"""]
    for i in range(1, 7):
        out += [
            f"""h{i} AS (SELECT {keep}, dl, lam, su1, cu1, su2, cu2, sqrt(pow(cu2 * sin(lam), 2) + pow(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS ss, su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM g{i - 1})""",
            f"""k{i} AS (SELECT *, atan2(ss, cs) AS arc, CASE WHEN ss = 0 THEN 0 ELSE cu1 * cu2 * sin(lam) / ss END AS sa FROM h{i})""",
            f"""m{i} AS (SELECT *, 1 - sa * sa AS ca, cs - 2 * su1 * su2 / (1 - sa * sa) AS cm, {_F} / 16 * (1 - sa * sa) * (4 + {_F} * (4 - 3 * (1 - sa * sa))) AS cc FROM k{i})""",
            f"""g{i} AS (SELECT {keep}, dl, dl + (1 - cc) * {_F} * sa * (arc + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam, su1, cu1, su2, cu2, ss, cs, arc, ca, cm FROM m{i})""",
        ]
    out += [
        f"w AS (SELECT *, ca * ({_A} * {_A} - {_B} * {_B}) / ({_B} * {_B}) AS u FROM g6)",
        "q AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS ka, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS kb FROM w)",
        f"geo AS (SELECT {keep}, {_B} * ka * (arc - kb * ss * (cm + kb / 4 * (cs * (2 * cm * cm - 1) - kb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS metros FROM q)",
    ]
    return ", ".join(out)


@query("x02_geodesic_metres", f"r AS (SELECT id, -17.7833::DOUBLE AS lat, -63.1821::DOUBLE AS lng, lat AS lat2, lng AS lng2 FROM propiedades), {inverse('r', 'id')} SELECT id, round(metros, 3) AS metros FROM geo")
def distance(spark, sf):
    placed = propiedades(spark, sf).select("id", "lat", "lng", F.lit(-17.7833).alias("y"), F.lit(-63.1821).alias("x"))
    return with_geodesic(placed, "y", "x", "lat", "lng", "metros").select("id", F.round("metros", 3).alias("metros"))


NEAR = f"r AS (SELECT p.id, s.id AS servicio_id, p.lat, p.lng, s.lat AS lat2, s.lng AS lng2 FROM propiedades p, servicios s WHERE abs(p.lat - s.lat) < 0.01 AND {haversine('p', 's')} <= 0.6), {inverse('r', 'id, servicio_id')}"


@query("j01_geodesic_join", f"{NEAR} SELECT id, servicio_id, round(metros, 3) AS metros FROM geo WHERE metros <= 500")
def radius(spark, sf):
    found = geodesic_join(propiedades(spark, sf).select("id", "lat", "lng"), servicios(spark, sf), 500, right_columns={"id": "servicio_id"})
    return found.select("id", "servicio_id", rounded(F.col("metros"), 3).alias("metros"))


def stored(spark, sf):
    """The listings, written in Morton order: the first delivery without every tenth row, the second with these."""
    p, folder = propiedades(spark, sf).select("id", "precio_usd", "lat", "lng"), f"{scratch_folder(spark)}/morton-{uuid.uuid4().hex}"
    morton.append(p.where("id % 10 <> 7"), folder, files=16)
    morton.append(p.where("id % 10 = 7"), folder, files=4)
    return folder


@query("j10_stored_radius", f"c AS (SELECT -17.7833::DOUBLE AS lat, -63.1833::DOUBLE AS lng) SELECT p.id, p.precio_usd, round({haversine('c', 'p')}, 6) AS km FROM propiedades p, c WHERE {haversine('c', 'p')} <= 3.0")
def point_radius(spark, sf):
    return morton.within(spark, stored(spark, sf), -17.7833, -63.1833, 3.0).select("id", "precio_usd", F.round("km", 6).alias("km"))


@query("f10_stored_box", f"SELECT id, precio_usd FROM propiedades WHERE lat BETWEEN {BOX_RAW[0]} AND -17.9 AND lng BETWEEN -63.3 AND {BOX_RAW[3]}")
def box(spark, sf):
    return morton.in_box(spark, stored(spark, sf), (BOX_RAW[0], -17.9, -63.3, BOX_RAW[3])).select("id", "precio_usd")
