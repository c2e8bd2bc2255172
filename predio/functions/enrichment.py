"""Price correction, zones, amenities and replies of a language model."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predio.functions import extraction as x

# How a price may be written, with the number as the first group.
CANDIDATES = [
    r"\$\s*([\d,\.]+)(?:\s*usd?)?", r"([\d,\.]+)\s*usd", r"([\d,\.]+)\s*dólares?", r"us\s*\$?\s*([\d,\.]+)", r"(\d+(?:\.\d{3})*(?:,\d{2})?)\s*bs", r"bs\s*([\d,\.]+)", r"bolivianos?\s*([\d,\.]+)", r"([\d,\.]+)\s*bob",
    r"precio[:\s]*\$?\s*([\d,\.]+)", r"costo[:\s]*\$?\s*([\d,\.]+)", r"valor[:\s]*\$?\s*([\d,\.]+)", r"monto[:\s]*\$?\s*([\d,\.]+)",
]
PRICE_WORDS = ["precio", "costo", "valor", "monto", "alquiler", "venta", "mensual", "dolares", "usd", "bolivianos", "bs", "bob"]

# Zones, avenues, rings and quarters.
ZONE_NAMES = [
    "equipetrol", "urubó", "urubo", "zona norte", "zona sur", "zona este", "zona oeste", "santa mónica", "santa monica", "los olivos", "urbari", "pampa de la isla", "el valle", "las brisas", "el palmar", "el mirador", "santo domingo",
    "guapay", "sarah", "abapo", "bienestar", "los lotes", "el pedregal", "villa 1ro de mayo", "villa primero de mayo", "plan 3000", "plan tres mil", "el cristo", "la recoleta", "av. monseñor rivero", "av. banzer", "av. beni",
    "zona central", "centro", "casco viejo", "la ramada", "mutualista", "virgen de luján", "virgen de lujan", "el trompillo", "paraguá", "av. cristobal de mendoza", "av. busch", "av. alemana", "av. roca y coronado",
    "av. paraguá", "av. santiesteban", "av. 6 de agosto", "av. cañoto", "radial 10", "radial 13", "radial 17", "radial 19", "radial 26", "radial 27", "2do anillo", "3er anillo", "4to anillo", "5to anillo", "6to anillo",
    "7mo anillo", "8vo anillo", "9no anillo", "segundo anillo", "tercer anillo", "cuarto anillo", "quinto anillo", "sexto anillo", "séptimo anillo", "octavo anillo", "noveno anillo", "las palmas", "barrio equipetrol",
    "barrio hamacas", "santos dumont", "barrio 26 de septiembre", "cambodromo", "parque industrial", "cataluña", "vida citadina", "barrio los pinos", "barrio jardín", "barrio sucre", "barrio libertad", "barrio san pedro",
    "norte villa", "norte villa country club", "san marcos", "country club", "club de golf", "golf & country club", "campestre", "el toro",
]

# Words of each kind of amenity.
AMENITY_KINDS = {
    "seguridad": ["seguridad", "vigilancia", "cámara", "alarma", "guardia", "portero", "control acceso"], "servicios_basicos": ["agua", "electricidad", "luz", "gas", "alcantarillado", "cloacas", "energía eléctrica", "medidor", "conexion"],
    "ubicacion": ["cerca", "cercano", "acceso", "avenida", "calle", "zona", "centro", "transporte", "colegio", "escuela", "hospital", "comercio", "supermercado", "iglesia", "plaza", "parque", "gimnasio"],
    "estacionamiento": ["parqueo", "garage", "garaje", "estacionamiento", "aparcamiento", "parqueadero", "cochera"], "areas_comunes": ["terraza", "balcón", "jardín", "patio", "sala", "lobby", "hall", "área social", "quincho", "piscina", "gimnasio", "spa", "sauna"],
    "comunicaciones": ["internet", "wifi", "cable", "televisión", "teléfono", "fibra óptica", "conectividad", "señal"], "clima": ["aire acondicionado", "calefacción", "ventilación", "clima", "climatización"],
    "cocina": ["cocina", "lavaplatos", "refrigerador", "horno", "microondas", "campana"], "banios": ["baño", "ducha", "jacuzzi", "hidromasaje", "calefón", "termotanque"],
    "estructura": ["ladrillo", "hormigón", "acero", "estructura", "techo", "piso", "cerámica", "porcelanato", "madera", "yeso", "piedra"],
}

# Kinds of services under one spelling.
SERVICE_TYPES = {
    "educación": "educacion", "educacion": "educacion", "escuela": "educacion", "colegio": "colegio", "universidad": "universidad", "academia": "academia", "salud": "salud", "hospital": "hospital", "clínica": "clinica", "clinica": "clinica",
    "farmacia": "farmacia", "centro de salud": "centro_de_salud", "comercio": "comercio", "supermercado": "supermercado", "tienda": "tienda", "centro comercial": "centro_comercial", "mercado": "mercado", "servicios": "servicios",
    "banco": "banco", "cajero automático": "cajero_automatico", "oficina": "oficina", "gobierno": "gobierno", "transporte": "transporte", "parada de bus": "parada_bus", "terminal": "terminal", "recreación": "recreacion",
    "recreacion": "recreacion", "parque": "parque", "plaza": "plaza", "deporte": "deporte",
}

CANDIDATE = T.ArrayType(T.StructType([T.StructField("precio", T.DoubleType()), T.StructField("moneda", T.StringType()), T.StructField("texto", T.StringType())]))


def _currency(found: str, text: str, at: int, value: float) -> str:
    """By the match, else by the 50 characters around it, else by size: over 10,000 is dollars."""
    for near in (found, text[max(0, at - 50) : at + len(found) + 50]):
        if "usd" in near or "$" in near or (near is not found and re.search("d[oó]lar", near)):
            return "USD"
        if any(w in near for w in ("bs", "bob", "boliviano")):
            return "BOB"
    return "USD" if value > 10_000 else "BOB"


@F.pandas_udf(CANDIDATE)
def price_candidates(texts: pd.Series) -> pd.Series:
    """Every price of a text with its currency; match positions are needed, which no built-in gives."""
    patterns = [re.compile(p) for p in CANDIDATES]

    def one(text: str | None) -> list[dict]:
        out = []
        low = (text or "").lower()
        for p in patterns:
            for m in p.finditer(low):
                try:
                    value = float(m[1].replace(",", ""))
                except ValueError:
                    continue
                if value >= 10:
                    out.append({"precio": value, "moneda": _currency(m[0], low, m.start(), value), "texto": m[0]})
        return out

    return texts.map(one)


def price_confidence(candidate: Column) -> Column:
    """Two for each price word in the match, one for a currency sign, one for a likely size."""
    text = candidate["texto"]
    words = sum((F.when(text.contains(w), 2).otherwise(0) for w in PRICE_WORDS), F.lit(0))
    sign = F.when(text.contains("$") | text.contains("usd") | text.contains("bs") | text.contains("boliviano"), 1).otherwise(0)
    return words + sign + F.when(candidate["precio"].between(100, 1_000_000), 1).otherwise(0)


def best_price(candidates: Column) -> Column:
    """The surest candidate, dollars before bolivianos, then the highest; null without any."""
    ranked = F.transform(candidates, lambda c: F.struct(price_confidence(c).alias("confianza"), (c["moneda"] == "USD").alias("usd"), c["precio"].alias("precio"), c["moneda"].alias("moneda")))
    return F.array_max(ranked)


def corrected_price(best: Column) -> Column:
    return F.when(best.isNotNull(), F.concat(F.format_number(best["precio"], 2), F.lit(" "), best["moneda"]))


def zone_name(text: Column) -> Column:
    """First zone named in a text, in title case."""
    names = "|".join(re.escape(z).replace("\\ ", " ").replace("\\&", "&") for z in ZONE_NAMES)
    found = F.regexp_extract(F.lower(text), rf"(?U)\b({names})\b", 1)
    return F.when(found != "", F.initcap(found))


def amenity_kinds(text: Column) -> Column:
    """Kinds of amenities of which a text has a word, in a fixed order."""
    low = F.lower(text)
    hit = lambda words: low.rlike(r"(?U)\b(" + "|".join(words) + r")\b")
    return F.array_compact(F.array(*[F.when(hit(words), F.lit(kind)) for kind, words in AMENITY_KINDS.items()]))


def service_type(text: Column) -> Column:
    """A service's kind under one spelling: article and plural off, then by the table; unknown kinds stay."""
    bare = F.regexp_replace(F.trim(F.lower(text)), r"^(el|la|los|las)\s+", "")
    table = F.create_map(*[F.lit(v) for pair in SERVICE_TYPES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, bare), F.try_element_at(table, F.regexp_replace(bare, "s$", "")), bare)


REPLY = "precio double, moneda string, habitaciones int, banos int, superficie double, zona string"


def model_reply(text: Column) -> Column:
    """Fields of a model's JSON reply, fenced or not; values out of range are null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?", ""), r"```$", ""))
    r = F.from_json(bare, REPLY)
    inside = lambda c, a, b: F.when(c.between(a, b), c)
    price = F.when(r["moneda"] == "Bs", inside(r["precio"], 70_000, 350_000_000)).otherwise(inside(r["precio"], 10_000, 50_000_000))
    return F.struct(price.alias("precio"), r["moneda"].alias("moneda"), inside(r["habitaciones"], 1, 20).alias("habitaciones"), inside(r["banos"], 1, 15).alias("banos"), inside(r["superficie"], 10, 100_000).alias("superficie"), r["zona"].alias("zona"))


def merged(by_rule: Column, by_model: Column) -> Column:
    """The rule's value where there is one, else the model's."""
    return F.coalesce(by_rule, by_model)


def sufficient(price: Column, zone: Column, surface: Column) -> Column:
    """Whether the rules found enough to leave out the model."""
    return price.isNotNull() & (zone.isNotNull() | surface.isNotNull())


def found_fields(text: Column) -> Column:
    """How many fields the rules find; the currency always counts."""
    fields = [x.price(text), x.surface(text), x.rooms(text), x.baths(text), zone_name(text), x.garages(text), x.operation(text), x.agent(text), x.contact(text)]
    lists = [x.rings(text), x.amenities(text)]
    return F.lit(1) + reduce(lambda a, b: a + b, [F.when(f.isNotNull(), 1).otherwise(0) for f in fields] + [F.when(F.size(v) > 0, 1).otherwise(0) for v in lists])
