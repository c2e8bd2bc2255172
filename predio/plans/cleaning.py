"""Field parsing, status and text extraction over raw listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from predio import schema
from predio.functions import cleansing as c
from predio.functions import extraction as x
from predio.functions.geo import parse_point, planar_closeness, repair_coordinates
from predio.plans.registry import query
from predio.sources.views import agentes, crudos, propiedades, servicios, table

T = "regexp_replace(precio, '[^0-9.,]', '', 'g')"
PRICE_SQL = f"""try_cast(CASE WHEN precio = 'nan' THEN NULL WHEN contains({T}, ',') AND contains({T}, '.') THEN
  CASE WHEN strpos(reverse({T}), ',') < strpos(reverse({T}), '.') THEN replace(replace({T}, '.', ''), ',', '.') ELSE replace({T}, ',', '') END
  WHEN contains({T}, ',') THEN CASE WHEN len(string_split({T}, ',')) = 2 AND length(string_split({T}, ',')[2]) <= 2 THEN replace({T}, ',', '.') ELSE replace({T}, ',', '') END
  ELSE {T} END AS DOUBLE)"""


@query("x05_price_parse", f"SELECT id, {PRICE_SQL} AS valor FROM crudos")
def price(spark, sf):
    return crudos(spark, sf).select("id", c.parse_price(F.col("precio")).alias("valor"))


USD = "try_cast(trim(replace(replace(replace(replace(replace(replace(replace(replace(precio, '$', ''), 'USD', ''), 'Usd', ''), 'BOB', ''), 'Bs.', ''), 'BS', ''), 'bolivianos', ''), ',', '')) AS DOUBLE)"
BOB = "(contains(upper(precio), 'BOB') OR contains(upper(precio), 'BS'))"


@query("x06_price_in_usd", f"SELECT id, round(coalesce(CASE WHEN isnan({USD}) THEN NULL WHEN {BOB} THEN {USD} / 6.96::DOUBLE ELSE {USD} END, 0), 4) AS usd, CASE WHEN {BOB} THEN 'BOB' ELSE 'USD' END AS moneda FROM crudos")
def usd(spark, sf):
    p = c.price_in_usd(F.col("precio"))
    return crudos(spark, sf).select("id", F.round(F.when(F.isnan(p["usd"]), 0.0).otherwise(p["usd"]), 4).alias("usd"), p["moneda"].alias("moneda"))


@query("x07_number_parse", "SELECT id, CAST(trunc(try_cast(replace(CASE WHEN id % 3 = 0 THEN (id % 100) || ',7' WHEN id % 3 = 1 THEN (id % 100) || '.2' ELSE 'texto' END, ',', '.') AS DOUBLE)) AS BIGINT) AS valor FROM propiedades")
def number(spark, sf):
    k = F.col("id")
    raw = F.when(k % 3 == 0, F.concat((k % 100).cast("string"), F.lit(",7"))).when(k % 3 == 1, F.concat((k % 100).cast("string"), F.lit(".2"))).otherwise("texto")
    return propiedades(spark, sf).select("id", c.parse_number(raw).alias("valor"))


@query("x08_surface_parse", "SELECT id, try_cast(trim(replace(replace(replace(replace(lower(superficie), 'mt2', ''), 'm2', ''), 'm²', ''), ',', '')) AS DOUBLE) AS m2 FROM crudos")
def surface(spark, sf):
    return crudos(spark, sf).select("id", c.parse_surface(F.col("superficie")).alias("m2"))


@query("x09_date_parse", "SELECT id, CASE WHEN id % 5 = 3 THEN NULL WHEN id % 5 = 4 THEN strftime(dia, '%Y-%m-%d %H:%M:%S') ELSE strftime(dia, '%Y-%m-%d') || ' 00:00:00' END AS fecha FROM crudos")
def date(spark, sf):
    return crudos(spark, sf).select("id", F.date_format(c.parse_date(F.col("fecha")), "yyyy-MM-dd HH:mm:ss").alias("fecha"))


IN = "(lat BETWEEN -18.2 AND -17.5 AND lng BETWEEN -63.5 AND -63.0)"
SW = "(lng BETWEEN -18.2 AND -17.5 AND lat BETWEEN -63.5 AND -63.0)"
PW = "list_filter([1e16, 1e15, 1e14, 1e13, 1e12, 1e11, 1e10, 1e9, 1e8, 1e7, 1e6, 1e5, 1e4, 1e3, 1e2], lambda p: {c} / p BETWEEN {a} AND {b})[1]"
LP, GP = PW.format(c="lat", a=-18.2, b=-17.5), PW.format(c="lng", a=-63.5, b=-63.0)
HOW = f"CASE WHEN lat = 0 OR lng = 0 THEN 'vacias' WHEN {IN} THEN 'validas' WHEN {SW} THEN 'invertidas' WHEN (abs(lat) > 100 OR abs(lng) > 100) AND {LP} IS NOT NULL AND {GP} IS NOT NULL THEN 'normalizadas' WHEN -abs(lat) BETWEEN -18.2 AND -17.5 AND -abs(lng) BETWEEN -63.5 AND -63.0 THEN 'signos' ELSE 'fuera' END"


@query("x10_coordinate_repair", f"h AS (SELECT *, {HOW} AS how FROM crudos) SELECT id, how, round(CASE how WHEN 'vacias' THEN NULL WHEN 'invertidas' THEN lng WHEN 'normalizadas' THEN lat / {LP} WHEN 'signos' THEN -abs(lat) ELSE lat END, 6) AS lat, round(CASE how WHEN 'vacias' THEN NULL WHEN 'invertidas' THEN lat WHEN 'normalizadas' THEN lng / {GP} WHEN 'signos' THEN -abs(lng) ELSE lng END, 6) AS lng FROM h")
def repair(spark, sf):
    r = repair_coordinates(F.col("lat"), F.col("lng"), schema.BOX_RAW)
    return crudos(spark, sf).select("id", r.alias("r")).select("id", "r.how", F.round("r.lat", 6).alias("lat"), F.round("r.lng", 6).alias("lng"))


@query("x11_point_text", "SELECT id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM propiedades")
def point(spark, sf):
    text = F.concat_ws(", ", F.col("lat").cast("string"), F.col("lng").cast("string"))
    return propiedades(spark, sf).select("id", parse_point(text).alias("p")).select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


@query("x12_text_cleaning", "SELECT id, 'Ana María ' || (id % 50) AS nombre FROM crudos")
def cleaning(spark, sf):
    return crudos(spark, sf).select("id", c.clean_text(F.col("nombre")).alias("nombre"))


def _cases(rules, text):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{v}'" for p, v in rules) + " END"


@query("x13_zone_from_text", f"SELECT id, {_cases(c.ZONE_RULES, 'lower(descripcion)')} AS por_descripcion, {_cases(c.ZONE_RULES, 'lower(titulo)')} AS por_titulo FROM crudos")
def zone(spark, sf):
    return crudos(spark, sf).select("id", c.zone_of(F.col("descripcion")).alias("por_descripcion"), c.zone_of(F.col("titulo")).alias("por_titulo"))


@query("x14_type_from_text", f"SELECT id, {_cases(c.TYPE_RULES, 'lower(titulo)')} AS tipo FROM crudos")
def kind(spark, sf):
    return crudos(spark, sf).select("id", c.type_of(F.col("titulo")).alias("tipo"))


CLEAN = f"""limpios AS (SELECT id, titulo, zona, tipo, {PRICE_SQL} AS precio_usd, CASE WHEN lat <> 0 THEN lat END AS lat, lng FROM crudos),
m AS (SELECT *, lat BETWEEN -18.5 AND -17.5 AND lng BETWEEN -63.5 AND -63.0 AS dentro FROM limpios),
v AS (SELECT *, CAST(lat IS NULL OR NOT dentro AS INTEGER) + CAST(precio_usd IS NULL OR precio_usd <= 0 OR precio_usd < 1000 OR precio_usd > 5000000 AS INTEGER) + CAST(coalesce(zona, '') = '' AS INTEGER) + CAST(tipo IS NULL AS INTEGER) AS faltas FROM m),
e AS (SELECT *, CASE WHEN faltas = 0 THEN 'OK' WHEN faltas <= 2 THEN 'WARNING' ELSE 'ERROR' END AS status FROM v)"""


def cleaned(spark, sf):
    """Raw listings with parsed prices, their faults and status."""
    rows = crudos(spark, sf).select("id", "titulo", "zona", "tipo", c.parse_price(F.col("precio")).alias("precio_usd"), F.when(F.col("lat") != 0, F.col("lat")).alias("lat"), "lng")
    inside = F.coalesce(F.col("lat").between(-18.5, -17.5) & F.col("lng").between(-63.5, -63.0), F.lit(False))
    rows = rows.withColumn("faltas", c.issues(F.col("titulo"), F.col("lat"), F.col("lng"), inside, F.col("precio_usd"), F.col("zona"), F.col("tipo")))
    return rows.withColumn("status", c.status(F.col("faltas")))


@query("x15_status", f"{CLEAN} SELECT id, status FROM e")
def status(spark, sf):
    return cleaned(spark, sf).select("id", "status")


@query("x16_observations", f"{CLEAN} SELECT id, coalesce(nullif(concat_ws('; ', CASE WHEN lat IS NULL THEN 'Sin coordenadas' WHEN NOT dentro THEN 'Coordenadas fuera de rango' END, CASE WHEN precio_usd IS NULL OR precio_usd <= 0 THEN 'Sin precio o precio inválido' WHEN precio_usd < 1000 OR precio_usd > 5000000 THEN 'Precio sospechoso' END, CASE WHEN coalesce(zona, '') = '' THEN 'Sin zona' END, CASE WHEN tipo IS NULL THEN 'Sin tipo de propiedad' END), ''), 'Sin observaciones') AS observaciones FROM e")
def observations(spark, sf):
    return cleaned(spark, sf).select("id", F.when(F.size("faltas") > 0, F.array_join("faltas", "; ")).otherwise("Sin observaciones").alias("observaciones"))


@query("f11_approval", f"{CLEAN} SELECT coalesce(status IN ('OK', 'WARNING') AND titulo <> '' AND dentro AND precio_usd BETWEEN 1000 AND 5000000 AND coalesce(zona, '') <> '' AND tipo IS NOT NULL, false) AS aprobada, count(*) AS n FROM e GROUP BY 1")
def approval(spark, sf):
    from predio.operators.filters import approved

    return cleaned(spark, sf).groupBy(approved(schema.BOX_LOAD).alias("aprobada")).agg(F.count("*").alias("n"))


@query("x17_row_status", f"{CLEAN} SELECT CASE WHEN lat IS NULL THEN 'SIN_COORDENADAS' WHEN precio_usd IS NULL THEN 'ERROR_PRECIO' WHEN coalesce(zona, '') = '' OR tipo IS NULL THEN 'DATOS_INCOMPLETOS' ELSE 'OK' END AS estado, count(*) AS n FROM e GROUP BY 1")
def row_status(spark, sf):
    state = F.when(F.col("lat").isNull(), "SIN_COORDENADAS").when(F.col("precio_usd").isNull(), "ERROR_PRECIO").when((F.coalesce("zona", F.lit("")) == "") | F.col("tipo").isNull(), "DATOS_INCOMPLETOS").otherwise("OK")
    return cleaned(spark, sf).groupBy(state.alias("estado")).agg(F.count("*").alias("n"))


@query("x18_price_validity", f"{CLEAN} SELECT id, CASE WHEN precio_usd IS NULL THEN 'sin precio' WHEN precio_usd < 10000 THEN 'muy bajo' WHEN precio_usd > 2000000 THEN 'muy alto' ELSE 'válido' END AS motivo FROM e")
def price_validity(spark, sf):
    p = F.col("precio_usd")
    return cleaned(spark, sf).select("id", F.when(p.isNull(), "sin precio").when(p < 10_000, "muy bajo").when(p > 2_000_000, "muy alto").otherwise("válido").alias("motivo"))


D = "lower(descripcion)"


@query("x19_text_price", f"SELECT id, try_cast(coalesce(nullif(regexp_extract({D}, '\\$\\s*us\\s*([\\d,.]+)', 1), ''), nullif(regexp_extract({D}, '([\\d,.]+)\\s*bs', 1), ''), nullif(regexp_extract({D}, 'precio[:\\s]+([\\d,.]+)', 1), '')).replace(',', '').replace('.', '') AS DOUBLE) AS precio, CASE WHEN regexp_matches({D}, '\\$\\s*us|usd|d[oó]lar') THEN 'USD' WHEN regexp_matches({D}, 'bs|boliviano') THEN 'BOB' ELSE 'USD' END AS moneda FROM crudos")
def text_price(spark, sf):
    d = F.col("descripcion")
    return crudos(spark, sf).select("id", x.price(d).alias("precio"), x.currency(d).alias("moneda"))


@query("x21_text_surface", f"SELECT id, try_cast(coalesce(nullif(regexp_extract({D}, 'superficie[:\\s]+([\\d,.]+)\\s*m', 1), ''), nullif(regexp_extract({D}, '(\\d+)\\s*mt2', 1), '')) AS DOUBLE) AS m2 FROM crudos")
def text_surface(spark, sf):
    return crudos(spark, sf).select("id", x.surface(F.col("descripcion")).alias("m2"))


@query("x22_rooms_and_baths", f"SELECT id, CAST(regexp_extract({D}, '(\\d+)\\s+dormitorio', 1) AS INTEGER) AS dormitorios, CAST(regexp_extract({D}, '(\\d+)\\s+ba[ñn]o', 1) AS DOUBLE) AS banos, CASE WHEN contains({D}, 'cochera') THEN 1 END AS garajes FROM crudos")
def rooms(spark, sf):
    d = F.col("descripcion")
    return crudos(spark, sf).select("id", x.rooms(d).alias("dormitorios"), x.baths(d).alias("banos"), x.garages(d).alias("garajes"))


@query("x24_rings_and_radials", f"SELECT id, CAST(regexp_extract({D}, '(\\d+)(?:do|er|to|mo|vo|no)?\\s+anillo', 1) AS INTEGER) AS anillo, CAST(regexp_extract({D}, 'radial\\s+(\\d+)', 1) AS INTEGER) AS radial FROM crudos")
def rings(spark, sf):
    d = F.col("descripcion")
    return crudos(spark, sf).select("id", F.get(x.rings(d), F.lit(0)).alias("anillo"), F.get(x.radials(d), F.lit(0)).alias("radial"))


@query("x25_amenities", "SELECT id, array_to_string(list_filter(['piscina', 'gimnasio', 'seguridad', 'jardín', 'terraza', 'balcón', 'wifi'], lambda k: contains(lower(descripcion), k)), ',') AS amenidades FROM crudos")
def amenities(spark, sf):
    wanted = F.array(*[F.lit(k) for k in ("piscina", "gimnasio", "seguridad", "jardín", "terraza", "balcón", "wifi")])
    return crudos(spark, sf).select("id", F.array_join(F.array_intersect(wanted, x.amenities(F.col("descripcion"))), ",").alias("amenidades"))


@query("x26_listing_state", f"SELECT id, CASE WHEN regexp_matches({D}, 'pre[-\\s]?venta') THEN 'preventa' WHEN regexp_matches({D}, 'venta|se vende') THEN 'venta' WHEN regexp_matches({D}, 'alquil|arriend') THEN 'alquiler' WHEN regexp_matches({D}, 'anticr[ée]tico') THEN 'anticretico' END AS operacion FROM crudos")
def state(spark, sf):
    return crudos(spark, sf).select("id", x.operation(F.col("descripcion")).alias("operacion"))


@query("x27_contact", f"SELECT id, CASE WHEN id % 5 = 0 THEN '7' || lpad(CAST(id % 997 AS VARCHAR), 7, '0') END AS contacto FROM crudos")
def contact(spark, sf):
    return crudos(spark, sf).select("id", x.contact(F.col("descripcion")).alias("contacto"))


@query("x33_normalised_people", "SELECT id, trim(replace('  ' || nombre || ' ', '  ', '')) AS nombre, CASE WHEN length(regexp_replace('(+591) ' || coalesce(telefono, ''), '[^0-9+]', '', 'g')) >= 7 THEN regexp_replace('(+591) ' || coalesce(telefono, ''), '[^0-9+]', '', 'g') END AS telefono FROM agentes")
def people(spark, sf):
    return agentes(spark, sf).select("id", c.person_name(F.concat(F.lit("  "), F.col("nombre"), F.lit(" "))).alias("nombre"), c.phone(F.concat(F.lit("(+591) "), F.coalesce("telefono", F.lit("")))).alias("telefono"))


@query("x34_service_category", "SELECT id, CASE WHEN regexp_matches(lower(subcategoria), 'brass|steel') THEN 'comercio' WHEN contains(lower(subcategoria), 'copper') THEN 'finanzas' ELSE 'otros' END AS categoria FROM servicios")
def category(spark, sf):
    return servicios(spark, sf).select("id", x.category(F.col("subcategoria"), [("brass", "comercio"), ("steel", "comercio"), ("copper", "finanzas")]).alias("categoria"))


@query("x36_address", "SELECT id, concat_ws(', ', 'UV ' || uv, 'MZ ' || manzana, nullif(zona, '')) AS direccion FROM propiedades")
def address(spark, sf):
    return propiedades(spark, sf).select("id", x.address(F.col("uv"), F.col("manzana"), F.col("zona")).alias("direccion"))


@query("x38_zone_in_question", "SELECT conv_id, turn, CASE WHEN contains(q, 'equipetrol') THEN 'equipetrol' WHEN contains(q, 'urbari') THEN 'urbari' WHEN contains(q, 'centro') THEN 'centro' END AS zona FROM (SELECT conv_id, turn, lower(text) || CASE CAST(turn % 4 AS INTEGER) WHEN 0 THEN ' en equipetrol' WHEN 1 THEN ' en urbari' WHEN 2 THEN ' del centro' ELSE '' END AS q FROM conversations)")
def asked_zone(spark, sf):
    t = F.col("turn") % 4
    q = F.concat(F.lower("text"), F.when(t == 0, " en equipetrol").when(t == 1, " en urbari").when(t == 2, " del centro").otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", c.first_contained(q, c.ASKED_ZONES).alias("zona"))


@query("x43_file_date", "SELECT id, substr(archivo, 1, 10) AS fecha FROM crudos")
def file_date(spark, sf):
    return crudos(spark, sf).select("id", c.file_date(F.col("archivo")).alias("fecha"))


@query("x44_budget", "SELECT id, round(least(a, b) * 0.8, 4) AS desde, round(greatest(a, b) * 1.2, 4) AS hasta FROM (SELECT id, CASE WHEN id % 900 + 1 < 1000 THEN (id % 900 + 1) * 1000.0 ELSE id % 900 + 1 END AS a, CAST(id % 90000 + 1000 AS DOUBLE) AS b FROM propiedades)")
def budget(spark, sf):
    text = F.concat(F.lit("entre "), (F.col("id") % 900 + 1).cast("string"), F.lit(" y "), (F.col("id") % 90_000 + 1000).cast("string"), F.lit(" usd"))
    return propiedades(spark, sf).select("id", c.budget(text).alias("b")).select("id", F.round("b.min", 4).alias("desde"), F.round("b.max", 4).alias("hasta"))


@query("x47_money_text", "SELECT id, CASE WHEN precio_usd IS NOT NULL THEN '$' || format('{:,}', CAST(round(precio_usd) AS BIGINT)) END AS texto FROM propiedades WHERE precio_usd - floor(precio_usd) <> 0.5")
def money(spark, sf):
    p = F.col("precio_usd")
    return propiedades(spark, sf).where(p - F.floor(p) != 0.5).select("id", F.concat(F.lit("$"), F.format_number(F.round(p), 0)).alias("texto"))


@query("x03_planar_closeness", "SELECT id, CASE WHEN lat IS NULL THEN 0.0 WHEN m < 100 THEN 1.0 WHEN m < 500 THEN 0.8 WHEN m < 1000 THEN 0.5 ELSE 0.0 END::DOUBLE AS cercania FROM (SELECT id, lat, sqrt(pow(abs(lat - -17.80::DOUBLE) * 111320, 2) + pow(abs(lng - -63.20::DOUBLE) * 111320 * abs(lat) / 90, 2)) AS m FROM propiedades)")
def closeness(spark, sf):
    return propiedades(spark, sf).select("id", planar_closeness(F.col("lat"), F.col("lng"), F.lit(-17.80), F.lit(-63.20)).alias("cercania"))
