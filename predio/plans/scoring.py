"""Scores, recommendations, leads and question routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from predio.functions.extraction import needs_to_categories
from predio.operators import leads as lead_ops
from predio.operators import recommend as rec
from predio.operators import router
from predio.operators.filters import zone_match
from predio.plans.registry import haversine, query
from predio.sources.views import agentes, propiedades, servicios, table

PROFILE = rec.Profile(zona="nation_1 nation_2", tipo="urgent", uv="7", manzana="1", precio_min=80_000, precio_max=180_000)


def thousandths(c: str) -> str:
    """Whole thousandths, cut off a little above, so that no engine's rounding of ties shows."""
    return f"CAST(floor({c} * 1000 + 0.000001::DOUBLE) AS BIGINT)"


def milli(c):
    return F.floor(c * 1000 + 0.000001).cast("long")


FACTORS = f"""base AS (SELECT *, CASE estado WHEN 'O' THEN 'alta' WHEN 'F' THEN 'media' ELSE 'baja' END AS demanda, CASE WHEN id % 3 = 0 THEN 'disponible' WHEN id % 3 = 1 THEN 'reservado' ELSE 'vendido' END AS disponible FROM propiedades),
cerca AS (SELECT p.id, s.categoria, {haversine('p', 's')} AS km FROM base p, servicios s WHERE s.categoria IN ('transporte', 'comercio', 'educacion', 'salud') AND abs(p.lat - s.lat) < 0.03 AND {haversine('p', 's')} <= 3.0),
n AS (SELECT id, count(*) FILTER (WHERE km <= 1) AS s1, count(*) FILTER (WHERE km <= 2) AS s2, count(*) AS s3, count(DISTINCT CASE WHEN km <= 1 THEN categoria END) AS c1, count(DISTINCT CASE WHEN km <= 2 THEN categoria END) AS c2, count(DISTINCT categoria) AS c3, count(*) FILTER (WHERE km <= 2 AND categoria = 'transporte') AS t2 FROM cerca GROUP BY id),
j AS (SELECT b.*, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(s3, 0) AS s3, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3, coalesce(t2, 0) AS t2, date_diff('day', CAST(fecha AS DATE), DATE '1998-08-02') AS dias FROM base b LEFT JOIN n USING (id)),
f AS (SELECT *,
 least(1.0::DOUBLE, CASE WHEN contains(lower(zona), 'nation_1 nation_2') THEN 0.4 WHEN contains(lower(zona), 'nation_1') OR contains(lower(zona), 'nation_2') THEN 0.25 ELSE 0 END::DOUBLE + CASE demanda WHEN 'alta' THEN 0.3 WHEN 'media' THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN contains(uv, '7') THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN contains(manzana, '1') THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN t2 >= 3 THEN 0.1 WHEN t2 >= 1 THEN 0.05 ELSE 0 END::DOUBLE) AS ubicacion,
 CASE WHEN coalesce(precio_usd, 0) = 0 THEN 0 ELSE least(1.0::DOUBLE, CASE WHEN precio_usd BETWEEN 80000 AND 180000 THEN 0.7::DOUBLE WHEN precio_usd < 80000 THEN greatest(0.2::DOUBLE, 0.7::DOUBLE - (80000 - precio_usd) / 100000 * 0.3::DOUBLE) ELSE greatest(0.1::DOUBLE, 0.7::DOUBLE - (precio_usd - 180000) / 100000 * 0.5::DOUBLE) END + CASE demanda WHEN 'media' THEN 0.2 WHEN 'baja' THEN 0.3 ELSE 0.05 END::DOUBLE) END AS s_precio,
 CASE WHEN lat IS NULL THEN 0.3::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.6::DOUBLE * c1 / 4 + 0.4::DOUBLE * least(s1 / 10.0::DOUBLE, 1.0::DOUBLE), (0.6::DOUBLE * c2 / 4 + 0.4::DOUBLE * least(s2 / 10.0::DOUBLE, 1.0::DOUBLE)) / 2, (0.6::DOUBLE * c3 / 4 + 0.4::DOUBLE * least(s3 / 10.0::DOUBLE, 1.0::DOUBLE)) / 3)) END AS s_servicios,
 least(1.0::DOUBLE, CASE WHEN contains(lower(tipo), 'urgent') THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN superficie >= 100 THEN 0.3 WHEN superficie >= 60 THEN 0.2 WHEN superficie > 0 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN (garajes > 0)::INT + (dormitorios >= 3)::INT + (banos >= 2)::INT + (superficie >= 200)::INT >= 3 THEN 0.3 WHEN (garajes > 0)::INT + (dormitorios >= 3)::INT + (banos >= 2)::INT + (superficie >= 200)::INT = 2 THEN 0.2 WHEN (garajes > 0)::INT + (dormitorios >= 3)::INT + (banos >= 2)::INT + (superficie >= 200)::INT = 1 THEN 0.1 ELSE 0 END::DOUBLE) AS caracteristicas,
 least(1.0::DOUBLE, CASE WHEN dias <= 7 THEN 0.6 WHEN dias <= 30 THEN 0.4 WHEN dias <= 90 THEN 0.2 ELSE 0.1 END::DOUBLE + CASE disponible WHEN 'disponible' THEN 0.4 WHEN 'reservado' THEN 0.2 ELSE 0.1 END::DOUBLE) AS disponibilidad FROM j),
t AS (SELECT *, 0.35::DOUBLE * ubicacion + 0.25::DOUBLE * s_precio + 0.20::DOUBLE * s_servicios + 0.15::DOUBLE * caracteristicas + 0.05::DOUBLE * disponibilidad AS total FROM f)"""


def listings(spark, sf):
    """Listings with a demand level of their sector and an availability."""
    demand = F.when(F.col("estado") == "O", "alta").when(F.col("estado") == "F", "media").otherwise("baja")
    k = F.col("id") % 3
    return propiedades(spark, sf).select("*", demand.alias("demanda"), F.when(k == 0, "disponible").when(k == 1, "reservado").otherwise("vendido").alias("disponible"))


@query("r01_compatibility_factors", f"{FACTORS} SELECT id, {thousandths('ubicacion')} AS ubicacion, {thousandths('s_precio')} AS precio, {thousandths('s_servicios')} AS servicios, {thousandths('caracteristicas')} AS caracteristicas, {thousandths('disponibilidad')} AS disponibilidad, {thousandths('total')} AS total FROM t")
def factors(spark, sf):
    rows = rec.scored(listings(spark, sf), servicios(spark, sf), PROFILE)
    w = rec.WEIGHTS
    total = w["ubicacion"] * F.col("ubicacion") + w["precio"] * F.col("s_precio") + w["servicios"] * F.col("s_servicios") + w["caracteristicas"] * F.col("caracteristicas") + w["disponibilidad"] * F.col("disponibilidad")
    names = (("ubicacion", "ubicacion"), ("s_precio", "precio"), ("s_servicios", "servicios"), ("caracteristicas", "caracteristicas"), ("disponibilidad", "disponibilidad"))
    return rows.select("id", *[milli(F.col(a)).alias(b) for a, b in names], milli(total).alias("total"))


SOFT = """, z AS (SELECT * FROM t WHERE contains(lower(zona), 'nation_1 nation_2') OR contains('nation_1 nation_2', lower(coalesce(zona, '')))),
u AS (SELECT * FROM z WHERE contains(uv, '7')), m AS (SELECT * FROM u WHERE contains(manzana, '1') OR NOT EXISTS (SELECT 1 FROM u WHERE contains(manzana, '1'))),
k AS (SELECT * FROM m WHERE contains(lower(tipo), 'urgent') OR NOT EXISTS (SELECT 1 FROM m WHERE contains(lower(tipo), 'urgent'))),
p AS (SELECT * FROM k WHERE coalesce(precio_usd, 0) BETWEEN 64000 AND 216000 OR NOT EXISTS (SELECT 1 FROM k WHERE coalesce(precio_usd, 0) BETWEEN 64000 AND 216000))"""


@query("r12_recommend", f"{FACTORS}{SOFT} SELECT id, zona, {thousandths('total')} AS total FROM p WHERE round(100 * total, 1) >= 30 ORDER BY round(100 * total, 1) DESC, id LIMIT 10")
def recommended(spark, sf):
    rows = rec.recommend(listings(spark, sf), servicios(spark, sf), PROFILE)
    w = rec.WEIGHTS
    total = w["ubicacion"] * F.col("ubicacion") + w["precio"] * F.col("s_precio") + w["servicios"] * F.col("s_servicios") + w["caracteristicas"] * F.col("caracteristicas") + w["disponibilidad"] * F.col("disponibilidad")
    return rows.select("id", "zona", milli(total).alias("total"))


@query("r08_budget_closeness", "SELECT id, round(CASE WHEN coalesce(precio_usd, 0) = 0 THEN 0 ELSE greatest(0, 1 - abs(precio_usd - 130000) / 130000) END, 4) AS cercania FROM propiedades")
def closeness(spark, sf):
    return propiedades(spark, sf).select("id", F.round(rec.budget_closeness(PROFILE), 4).alias("cercania"))


R09 = """SELECT id, round(least(1.0, CASE WHEN dormitorios >= 2 THEN 0.4 WHEN dormitorios > 0 THEN greatest(0.1, dormitorios / 2.0 * 0.4) ELSE 0 END::DOUBLE
  + CASE WHEN banos >= 4 / 3.0 THEN 0.25 ELSE greatest(0.05, banos / (4 / 3.0) * 0.25) END::DOUBLE + CASE WHEN superficie >= 100 THEN 0.2 WHEN superficie > 0 THEN greatest(0.05, superficie / 100 * 0.2) ELSE 0 END::DOUBLE
  + CASE WHEN garajes > 0 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN id % 4 <> 0 THEN 0 WHEN id % 5 >= 3 THEN 0.05 WHEN id % 5 >= 1 THEN 0.03 ELSE 0 END::DOUBLE), 4) AS ajuste FROM propiedades"""


@query("r09_family_fit", R09)
def fit(spark, sf):
    rows = propiedades(spark, sf).withColumn("condominio", F.col("id") % 4 == 0).withColumn("n_amenidades", F.col("id") % 5)
    return rows.select("id", F.round(rec.family_fit(2, 2), 4).alias("ajuste"))


@query("x37_needs", "SELECT id, CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN 'educacion,salud' WHEN 1 THEN 'abastecimiento,transporte' WHEN 2 THEN 'deporte,otros' ELSE 'educacion,salud,transporte' END AS categorias FROM agentes")
def needs(spark, sf):
    k = F.col("id") % 4
    asked = F.when(k == 0, F.array(F.lit("Prestigio"))).when(k == 1, F.array(F.lit("plusvalia"), F.lit("comercio"))).when(k == 2, F.array(F.lit("areas_comunes"))).otherwise(F.array(F.lit("nada")))
    return agentes(spark, sf).select("id", F.array_join(needs_to_categories(asked), ",").alias("categorias"))


LEADS = """prospectos AS (SELECT c_custkey AS id, CAST(c_custkey % 4 AS INT) AS adultos, CAST(c_custkey % 3 AS INT) AS ninos, CAST(c_custkey % 2 AS INT) AS adolescentes, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS mayores, 40000 + abs(c_acctbal) * 20 AS pmin, 60000 + abs(c_acctbal) * 40 AS pmax, c_custkey % 5 = 0 AS financiamiento,
  CASE WHEN c_custkey % 3 = 0 THEN 30000 ELSE 0 END AS cuota, CAST(c_custkey % 5 AS INT) AS dormitorios, CAST(c_custkey % 3 AS INT) AS banos, CASE WHEN c_custkey % 2 = 0 THEN 'casa' ELSE '' END AS tipo, CAST(c_custkey % 4 AS INT) AS nz, CAST(c_custkey * 37 % 7000 AS INT) AS disponibles, CAST(c_custkey % 200 AS INT) AS superficie,
  CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'alto' WHEN 1 THEN 'medio' ELSE 'bajo' END AS conocimiento, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'alta' WHEN 1 THEN 'media' WHEN 2 THEN 'baja' ELSE '' END AS urgencia FROM customer),
q AS (SELECT *, (pmin + pmax) / 2 AS med, CASE WHEN mayores > 0 THEN 'adultos_mayores' WHEN ninos + adolescentes > 0 THEN CASE WHEN adultos + ninos + adolescentes <= 4 THEN 'familia_pequena' ELSE 'familia_grande' END WHEN adultos = 1 THEN 'soltero' WHEN adultos = 2 THEN 'pareja_sin_hijos' ELSE 'otro' END AS perfil FROM prospectos),
s AS (SELECT *, CASE WHEN med < 50000 THEN 0 WHEN med > 500000 THEN 5 WHEN perfil = 'familia_grande' AND med < 180000 THEN 5 WHEN perfil = 'soltero' AND med > 300000 THEN 8 WHEN med BETWEEN 150000 AND 250000 THEN 20 WHEN med BETWEEN 100000 AND 350000 THEN 15 ELSE 10 END AS a,
  CASE urgencia WHEN 'alta' THEN 15 WHEN 'media' THEN 10 WHEN 'baja' THEN 5 ELSE 3 END AS b, least(15, CASE WHEN dormitorios > 0 THEN 4 ELSE 0 END + CASE WHEN banos > 0 THEN 3 ELSE 0 END + CASE WHEN tipo <> '' THEN 3 ELSE 0 END + CASE WHEN nz > 0 THEN 3 ELSE 0 END + CASE WHEN superficie > 0 THEN 2 ELSE 0 END) AS c,
  CASE WHEN NOT financiamiento AND pmax < 100000 THEN 3 WHEN financiamiento THEN 12 WHEN cuota > 0 AND cuota >= pmax * 0.2 THEN 10 ELSE 6 END AS d, CASE WHEN adultos = 0 THEN 0 ELSE least(10, 5 + CASE WHEN ninos + adolescentes > 0 THEN 3 ELSE 0 END + CASE WHEN mayores > 0 THEN 2 ELSE 0 END) END AS e,
  CASE WHEN nz = 0 THEN 2 WHEN disponibles > 5000 THEN 8 WHEN disponibles > 2000 THEN 6 WHEN disponibles > 500 THEN 4 ELSE 2 END AS f, CASE conocimiento WHEN 'alto' THEN 7 WHEN 'medio' THEN 5 ELSE 3 END AS g, CASE WHEN financiamiento THEN 8 WHEN cuota > 0 THEN 5 ELSE 2 END AS h FROM q),
r AS (SELECT *, round((a * 20 + b * 15 + c * 15 + d * 12 + e * 10 + f * 8 + g * 7 + h * 8) / 20.0::DOUBLE, 2) AS crudo FROM s)"""


def leads(spark, sf):
    """Leads from customers, with everything the score asks for."""
    k, w = F.col("c_custkey"), F.abs("c_acctbal")
    i = lambda n: (k % n).cast("int")
    return table(spark, sf, "customer").select(
        k.alias("id"), i(4).alias("adultos"), i(3).alias("ninos"), i(2).alias("adolescentes"), F.when(k % 7 == 0, 1).otherwise(0).alias("mayores"), (40_000 + w * 20).alias("presupuesto_min"), (60_000 + w * 40).alias("presupuesto_max"),
        (k % 5 == 0).alias("financiamiento"), F.when(k % 3 == 0, 30_000).otherwise(0).alias("cuota"), i(5).alias("dormitorios"), i(3).alias("banos"), F.when(k % 2 == 0, "casa").otherwise("").alias("tipo"), i(4).alias("n_zonas"),
        (k * 37 % 7000).cast("int").alias("disponibles"), i(200).alias("superficie"), F.when(k % 3 == 0, "alto").when(k % 3 == 1, "medio").otherwise("bajo").alias("conocimiento"),
        F.when(k % 4 == 0, "alta").when(k % 4 == 1, "media").when(k % 4 == 2, "baja").otherwise("").alias("urgencia"),
    )


@query("r13_lead_score", f"{LEADS} SELECT id, a AS presupuesto, b AS urgencia, c AS necesidades, d AS potencial, e AS composicion, f AS ubicacion, g AS conocimiento, h AS financiamiento, crudo AS puntuacion FROM r")
def lead_score(spark, sf):
    rows = lead_ops.score(leads(spark, sf))
    exact = F.round(sum((F.col(f"p_{n}") * w for n, w in lead_ops.WEIGHTS.items()), F.lit(0)) / 20.0, 2)
    return rows.select("id", *[F.col(f"p_{n}").alias(n) for n in lead_ops.WEIGHTS], exact.alias("puntuacion"))


@query("r14_lead_profile", f"{LEADS} SELECT perfil, count(*) AS n, count(*) FILTER (WHERE a >= 15) AS presupuesto_realista, count(*) FILTER (WHERE h < 5) AS sin_financiamiento FROM r GROUP BY perfil")
def lead_profile(spark, sf):
    rows = lead_ops.score(leads(spark, sf)).select("perfil", lead_ops.strengths().alias("f"), lead_ops.weaknesses().alias("d"))
    return rows.groupBy("perfil").agg(F.count("*").alias("n"), F.count_if(F.array_contains("f", "Presupuesto realista y adecuado")).alias("presupuesto_realista"), F.count_if(F.array_contains("d", "Financiamiento no definido")).alias("sin_financiamiento"))


QUESTIONS = ["¿Cuáles son los más caros del centro?", "los más baratos de zona norte", "¿Cuántas propiedades hay en zona sur?", "precio promedio en equipetrol", "¿Qué hay en urbari?", "hola"]


@query("r15_question_answers")
def answers(spark, sf):
    zones = F.element_at(F.array(*[F.lit(z) for z in ("Centro", "Zona Norte", "Zona Sur", "Equipetrol", "Urbari")]), (F.col("id") % 5 + 1).cast("int"))
    rows = propiedades(spark, sf).withColumn("zona", zones)
    parts = [router.answer(rows, q).select(F.lit(q).alias("consulta"), "*") for q in QUESTIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MESSAGE = "mensajes AS (SELECT conv_id, turn, role, lower(text) || CASE CAST(turn % 5 AS INTEGER) WHEN 0 THEN ' busco una casa' WHEN 1 THEN ' precio del mercado' WHEN 2 THEN ' quiero saber' WHEN 3 THEN ' de política' ELSE ' en otra zona' END AS q FROM conversations)"


def messages(spark, sf):
    t = F.col("turn") % 5
    tail = F.when(t == 0, " busco una casa").when(t == 1, " precio del mercado").when(t == 2, " quiero saber").when(t == 3, " de política").otherwise(" en otra zona")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(F.lower("text"), tail).alias("q"))


def _has(words):
    return " OR ".join(f"contains(q, '{w}')" for w in words)


@query("r16_intent", f"{MESSAGE} SELECT conv_id, turn, CASE WHEN {_has(router.SEARCH)} THEN 'property_search' WHEN {_has(router.MARKET)} THEN 'market_analysis' WHEN {_has(router.INFO)} THEN 'general_info' ELSE 'general' END AS intencion FROM mensajes")
def intents(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", router.intent(F.col("q")).alias("intencion"))


@query("r17_guard", f"{MESSAGE} SELECT conv_id, turn, CASE WHEN {_has(router.FORBIDDEN)} THEN 'tema' WHEN ({_has(router.PLACE_WORDS)}) AND NOT ({_has(router.ALLOWED_ZONES)}) THEN 'zona' ELSE 'ok' END AS guardia FROM mensajes")
def guards(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", router.guard(F.col("q")).alias("guardia"))


@query("f06_zone_counts", "SELECT zona, count(*) AS n FROM propiedades WHERE contains(lower(zona), 'nation_1') OR contains('nation_1', lower(zona)) GROUP BY zona")
def zone_counts(spark, sf):
    return propiedades(spark, sf).where(zone_match(F.col("zona"), "nation_1")).groupBy("zona").agg(F.count("*").alias("n"))
