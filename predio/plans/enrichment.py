"""Price correction, zone names, amenity kinds, model replies, demography and chat answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from predio.functions import enrichment as e
from predio.functions import extraction as x
from predio.operators.spatial import counts_up_to
from predio.plans.registry import haversine, query
from predio.plans.scoring import PROFILE, listings
from predio.sources.views import crudos, propiedades, servicios


@query("x23_zone_name", "SELECT id, CASE regexp_extract(lower(descripcion), '(equipetrol|urbari|zona norte|centro|los olivos|el palmar|plan 3000)', 1) WHEN 'equipetrol' THEN 'Equipetrol' WHEN 'urbari' THEN 'Urbari' WHEN 'zona norte' THEN 'Zona Norte' WHEN 'centro' THEN 'Centro' WHEN 'los olivos' THEN 'Los Olivos' WHEN 'el palmar' THEN 'El Palmar' ELSE 'Plan 3000' END AS zona FROM crudos")
def zone_name(spark, sf):
    return crudos(spark, sf).select("id", e.zone_name(F.col("descripcion")).alias("zona"))


@query("x28_found_fields")
def found(spark, sf):
    return crudos(spark, sf).select("id", e.found_fields(F.col("descripcion")).alias("campos"))


@query("x29_price_candidates")
def candidates(spark, sf):
    return crudos(spark, sf).select("id", F.explode(e.price_candidates("descripcion")).alias("c")).select("id", "c.*")


X31 = """SELECT id, CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN format('{:,.2f}', p::DOUBLE) || ' USD' WHEN 1 THEN format('{:,.2f}', (p % 9000 + 500)::DOUBLE) || ' BOB'
  WHEN 2 THEN format('{:,.2f}', p::DOUBLE) || CASE WHEN p > 10000 THEN ' USD' ELSE ' BOB' END END AS corregido FROM (SELECT id, CAST(trunc(o_totalprice) AS BIGINT) AS p FROM crudos JOIN orders ON o_orderkey = id)"""


@query("x31_price_correction", X31)
def correction(spark, sf):
    """Every listing, null where its text has no price."""
    return corrected(crudos(spark, sf))


@query("x31_price_correction_all", X31)
def correction_all(spark, sf):
    return correction(spark, sf)


def corrected(rows):
    rows = rows.select("id", e.best_price(e.price_candidates("descripcion")).alias("b"))
    return rows.select("id", e.corrected_price(F.col("b")).alias("corregido"))


@query("x32_amenity_kinds", "SELECT id, array_to_string(list_filter([CASE WHEN contains(d, 'seguridad') THEN 'seguridad' END, CASE WHEN contains(d, 'centro') OR contains(d, 'zona') OR contains(d, 'gimnasio') THEN 'ubicacion' END, CASE WHEN contains(d, 'cochera') THEN 'estacionamiento' END, CASE WHEN regexp_matches(d, 'terraza|balcón|jardín|piscina|gimnasio') THEN 'areas_comunes' END, CASE WHEN contains(d, 'wifi') THEN 'comunicaciones' END], lambda k: k IS NOT NULL), ',') AS clases FROM (SELECT id, lower(descripcion) AS d FROM crudos)")
def kinds(spark, sf):
    return crudos(spark, sf).select("id", F.array_join(e.amenity_kinds(F.col("descripcion")), ",").alias("clases"))


@query("x35_service_type", "SELECT id, CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN 'colegio' WHEN 1 THEN 'educacion' WHEN 2 THEN 'banco' ELSE 'taller' END AS clase FROM servicios")
def service_type(spark, sf):
    k = F.col("id") % 4
    raw = F.when(k == 0, "Los Colegios").when(k == 1, " la Escuela").when(k == 2, "Bancos").otherwise("taller")
    return servicios(spark, sf).select("id", e.service_type(raw).alias("clase"))


@query("x45_model_reply", "SELECT id, CASE WHEN precio_usd BETWEEN 10000 AND 50000000 THEN round(precio_usd, 2) END AS precio, CASE WHEN dormitorios BETWEEN 1 AND 20 THEN dormitorios END AS habitaciones, CASE WHEN superficie BETWEEN 10 AND 100000 THEN superficie END AS superficie FROM propiedades")
def reply(spark, sf):
    body = F.to_json(F.struct(F.col("precio_usd").alias("precio"), F.lit("USD").alias("moneda"), F.col("dormitorios").alias("habitaciones"), "superficie"))
    fenced = F.when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    r = propiedades(spark, sf).select("id", e.model_reply(fenced).alias("r"))
    return r.select("id", F.round("r.precio", 2).alias("precio"), "r.habitaciones", "r.superficie")


@query("x46_rule_or_model", "SELECT CASE WHEN id % 4 <> 3 THEN true ELSE false END AS basta, count(*) AS n FROM crudos GROUP BY 1")
def rule_or_model(spark, sf):
    d = F.col("descripcion")
    return crudos(spark, sf).groupBy(e.sufficient(x.price(d), e.zone_name(d), x.surface(d)).alias("basta")).agg(F.count("*").alias("n"))


R07 = f"""cerca AS (SELECT p.id, s.categoria, {haversine('p', 's')} AS km FROM propiedades p, servicios s WHERE s.categoria IN ('educacion', 'salud') AND abs(p.lat - s.lat) < 0.05 AND {haversine('p', 's')} <= 5.0),
n AS (SELECT id, count(*) FILTER (WHERE km <= 1) AS s1, count(*) FILTER (WHERE km <= 2) AS s2, count(*) FILTER (WHERE km <= 3) AS s3, count(*) AS s5, count(DISTINCT CASE WHEN km <= 1 THEN categoria END) AS c1, count(DISTINCT CASE WHEN km <= 2 THEN categoria END) AS c2, count(DISTINCT CASE WHEN km <= 3 THEN categoria END) AS c3, count(DISTINCT categoria) AS c5 FROM cerca GROUP BY id),
v AS (SELECT id, s1 + s2 + s3 + s5 AS todos, greatest((c1 / 2.0::DOUBLE * 0.5::DOUBLE + least(s1 / 5.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE) / 1, (c2 / 2.0::DOUBLE * 0.5::DOUBLE + least(s2 / 5.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE) / 2, (c3 / 2.0::DOUBLE * 0.5::DOUBLE + least(s3 / 5.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE) / 3, (c5 / 2.0::DOUBLE * 0.5::DOUBLE + least(s5 / 5.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE) / 5) AS mejor FROM n)"""


@query("r07_georeferenced_services", f"{R07} SELECT p.id, CAST(floor(1000 * CASE WHEN p.lat IS NULL THEN 0.3::DOUBLE WHEN todos IS NULL THEN 0.1::DOUBLE WHEN todos <= 3 THEN least(0.6::DOUBLE, mejor) WHEN todos <= 8 THEN least(0.8::DOUBLE, mejor) ELSE least(1.0::DOUBLE, mejor) END + 0.000001::DOUBLE) AS BIGINT) AS puntaje FROM propiedades p LEFT JOIN v USING (id)")
def georeferenced(spark, sf):
    p, wanted = propiedades(spark, sf).select("id", "lat", "lng"), ("educacion", "salud")
    rings = (1, 2, 3, 5)
    near = counts_up_to(p, servicios(spark, sf).where(F.col("categoria").isin(*wanted)), rings, "categoria", 9)  # the score tells no more than eight apart
    total = lambda kinds: F.aggregate(kinds, F.lit(0).cast("long"), lambda n, k: n + k["n"])
    n = near.select("id", "lat", *[c for r in rings for c in (total(F.col(f"near{r}")).alias(f"s{r}"), F.size(f"near{r}").alias(f"c{r}"))])
    best = F.greatest(*[(F.col(f"c{r}") / 2.0 * 0.5 + F.least(F.col(f"s{r}") / 5.0, F.lit(1.0)) * 0.5) / r for r in rings])
    every = sum((F.col(f"s{r}") for r in rings), F.lit(0))
    n = n.select("id", "lat", F.when(F.col("s5") > 0, every).alias("todos"), best.alias("mejor"))
    score = F.when(F.col("lat").isNull(), 0.3).when(F.col("todos").isNull(), 0.1).when(F.col("todos") <= 3, F.least(F.lit(0.6), "mejor")).when(F.col("todos") <= 8, F.least(F.lit(0.8), "mejor")).otherwise(F.least(F.lit(1.0), "mejor"))
    return n.select("id", F.floor(1000 * score + 0.000001).cast("long").alias("puntaje"))


LEVELS = "CASE WHEN id % 3 = 0 THEN 'alta' WHEN id % 3 = 1 THEN 'media' ELSE 'baja' END"


def level(n: int, names: tuple[str, str, str]):
    k = F.floor(F.col("id") / n) % 3
    return F.when(k == 0, names[0]).when(k == 1, names[1]).otherwise(names[2])


@query("r10_demography", "SELECT id, CAST(CASE id % 3 WHEN 0 THEN 40 WHEN 1 THEN 25 ELSE 10 END + CASE estado WHEN 'O' THEN 30 WHEN 'F' THEN 15 ELSE 0 END + CASE id // 2 % 3 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END + CASE id // 3 % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END AS INTEGER) AS puntos FROM propiedades")
def demography(spark, sf):
    rows = listings(spark, sf).withColumn("seguridad", level(1, ("alta", "media", "baja"))).withColumn("plusvalia", level(2, ("creciente", "estable", "decreciente"))).withColumn("nivel", level(3, ("alto", "medio", "bajo")))
    points = lambda c, table: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in table.items()], F.lit(0))
    total = points("seguridad", {"alta": 40, "media": 25, "baja": 10}) + points("demanda", {"muy_alta": 30, "alta": 30, "media": 15}) + points("plusvalia", {"creciente": 20, "estable": 10}) + points("nivel", {"alto": 10, "medio_alto": 10, "medio": 5})
    return rows.select("id", F.least(total, F.lit(100)).alias("puntos"))


@query("r11_preferences", "SELECT id, CAST(CASE WHEN contains(lower(zona), 'nation_1') THEN 35 ELSE 0 END + CASE WHEN contains(lower(tipo), 'urgent') THEN 25 ELSE 0 END + ((superficie >= 100)::INT + (garajes > 0)::INT) * 10 + CASE id % 3 WHEN 0 THEN 15 ELSE 0 END AS INTEGER) AS puntos FROM propiedades")
def preferences(spark, sf):
    wanted = F.array(F.lit("espacioso"), F.lit("garaje"))
    have = F.array_compact(F.array(F.when(F.col("superficie") >= 100, "espacioso"), F.when(F.col("garajes") > 0, "garaje")))
    share = F.size(F.array_intersect(wanted, have)) * 20 / F.size(wanted)
    points = F.when(F.lower("zona").contains("nation_1"), 35).otherwise(0) + F.when(F.lower("tipo").contains("urgent"), 25).otherwise(0) + share + F.when(F.col("id") % 3 == 0, 15).otherwise(0)
    return propiedades(spark, sf).select("id", points.cast("int").alias("puntos"))


@query("r18_chat_search")
def chat(spark, sf):
    from predio.operators.recommend import recommend

    rows = recommend(listings(spark, sf), servicios(spark, sf), PROFILE, k=5, threshold=0.01).limit(3)
    return rows.select("id", "zona", "compatibilidad", "justificacion")


@query("r19_briefing")
def briefing(spark, sf):
    from predio.operators.recommend import recommend

    rows = recommend(listings(spark, sf), servicios(spark, sf), PROFILE, k=3)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("compatibilidad")).alias("o"), "id", "zona", "justificacion")))  # three rows
    lines = F.transform(ranked, lambda r: F.concat(F.lit("- "), r["zona"], F.lit(": "), r["justificacion"]))
    return rows.agg(F.concat_ws("\n", F.lit("Resumen de opciones"), F.array_join(lines, "\n")).alias("texto"))


@query("p05_zone_view", "SELECT zona, count(*) AS n FROM propiedades GROUP BY zona HAVING count(*) > 5")
def zone_view(spark, sf):
    return spark.sql("SELECT zona, count(*) AS n FROM {vista} GROUP BY zona HAVING count(*) > 5", vista=propiedades(spark, sf))


@query("x04_points", "SELECT id, lat IS NOT NULL AND lng IS NOT NULL AND abs(lat) <= 90 AND abs(lng) <= 180 AS valido FROM servicios")
def points(spark, sf):
    p = servicios(spark, sf).select("id", F.struct("lat", "lng").alias("p"))
    return p.select("id", F.coalesce((F.abs("p.lat") <= 90) & (F.abs("p.lng") <= 180), F.lit(False)).alias("valido"))
