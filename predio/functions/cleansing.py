"""Parsing and normalising of raw fields."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predio.schema import BOB_PER_USD

BLANKS = ("", "nan", "none", "null")


#: A pattern that is only texts to be found, one of them.
TEXTS = re.compile(r"(?:[\w ]|\\\.)+(?:\|(?:[\w ]|\\\.)+)*")


def found(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found.  Alternatives that are plain texts are searched as bytes, without one that holds another."""
    if not TEXTS.fullmatch(pattern):
        return text.rlike(pattern)
    options = [o.replace("\\.", ".") for o in pattern.split("|")]
    least = [o for i, o in enumerate(options) if not any(other in o for j, other in enumerate(options) if other != o or j < i)]
    return reduce(lambda a, b: a | b, [text.contains(o) for o in least])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it; generated code stays small."""
    return F.transform(F.array(value), use)[0]


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first pattern that is found in ``text``; null if none is."""
    chain = reduce(lambda acc, rule: acc.when(found(text, rule[0]), F.lit(rule[1])), rules[1:], F.when(found(text, rules[0][0]), F.lit(rules[0][1])))
    return chain.otherwise(F.lit(None).cast("string"))


def first_contained(text: Column, keys: list[tuple[str, str]]) -> Column:
    """Value of the first key that ``text`` contains."""
    return reduce(lambda acc, k: acc.when(text.contains(k[0]), F.lit(k[1])), keys[1:], F.when(text.contains(keys[0][0]), F.lit(keys[0][1]))).otherwise(F.lit(None).cast("string"))


def blank_to_null(text: Column) -> Column:
    return F.when(~F.lower(F.trim(text)).isin(*BLANKS), F.trim(text))


def parse_price(text: Column) -> Column:
    """Number of a price text, telling a decimal mark from a thousands mark; a lone point is decimal."""
    t = F.regexp_replace(blank_to_null(text), r"[^\d.,]", "")
    comma, dot = F.locate(",", t) > 0, F.locate(".", t) > 0
    last_comma = F.length(t) - F.locate(",", F.reverse(t))
    last_dot = F.length(t) - F.locate(".", F.reverse(t))
    european = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(t, F.lit(","), F.lit(""))
    one_comma = (F.size(F.split(t, ",")) == 2) & (F.length(F.substring_index(t, ",", -1)) <= 2)
    cleaned = F.when(comma & dot, F.when(last_comma > last_dot, european).otherwise(plain)).when(comma & one_comma, F.replace(t, F.lit(","), F.lit("."))).when(comma, plain).otherwise(t)
    return cleaned.try_cast("double")


def parse_price_thousands(text: Column) -> Column:
    """Number of a price text in which a mark before three digits is a thousands mark, also a lone point."""
    t = F.regexp_replace(blank_to_null(text), r"[^\d.,]", "")
    return F.when(t.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.regexp_replace(t, "[.,]", "").try_cast("double")).otherwise(parse_price(text))


def price_in_usd(text: Column) -> Column:
    """struct(usd, moneda): symbols are dropped, bolivianos converted; 0 where there is no number."""
    bob = F.upper(text).contains("BOB") | F.upper(text).contains("BS") | F.upper(text).contains("BOLIVIANOS")
    bare = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), ("$", "USD", "Usd", "BOB", "Bs.", "BS", "bolivianos", ","), text)
    number = F.trim(bare).try_cast("double")
    usd = F.when(number.isNull(), 0.0).when(bob, number / BOB_PER_USD).otherwise(number)
    return F.struct(F.coalesce(usd, F.lit(0.0)).alias("usd"), F.when(text.isNotNull(), F.when(bob, "BOB").otherwise("USD")).alias("moneda"))


def parse_number(text: Column) -> Column:
    """Whole part of a number whose decimal mark may be a comma."""
    return F.replace(blank_to_null(text), F.lit(","), F.lit(".")).try_cast("double").cast("long")


def parse_number_thousands(text: Column) -> Column:
    """As ``parse_number``, but a comma before three digits is a thousands mark."""
    t = blank_to_null(text)
    return F.when(t.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(t, F.lit(","), F.lit("")).cast("long")).otherwise(parse_number(text))


def parse_surface(text: Column) -> Column:
    bare = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), ("mt2", "m2", "m²", ","), F.lower(text))
    return F.trim(bare).try_cast("double")


DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy.MM.dd")


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS])


def file_date(name: Column) -> Column:
    """yyyy.MM.dd at the beginning of a file name."""
    found = F.regexp_extract(name, r"^(\d{4}\.\d{2}\.\d{2})", 1)
    return F.when(found != "", found)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; Spark has no function for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


# Letters that went through a wrong decoding.
MOJIBAKE = [("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ")]


def clean_text(text: Column) -> Column:
    """Wrongly decoded letters mended, control characters dropped, white space collapsed."""
    mended = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), MOJIBAKE, F.coalesce(text, F.lit("")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(mended, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " "))
    return F.when(F.lower(tidy) == "nan", "").otherwise(tidy)


def phone(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^0-9+]", "")
    return F.when(F.length(digits) >= 7, digits)


def person_name(text: Column) -> Column:
    return F.initcap(F.trim(text))


# Zones by pattern, in order; an earlier one hides a later.
ZONE_RULES = [
    (r"equipetrol", "Equipetrol"), (r"centro|centro histórico|plaza 24 de septiembre|plaza principal", "Centro"), (r"primer anillo|1er anillo", "1er Anillo"),
    (r"segundo anillo|2do anillo", "2do Anillo"), (r"tercer anillo|3er anillo", "3er Anillo"), (r"cuarto anillo|4to anillo", "4to Anillo"), (r"quinto anillo|5to anillo", "5to Anillo"),
    (r"zona sur|sur", "Zona Sur"), (r"zona norte|norte", "Zona Norte"), (r"zona este|este", "Zona Este"), (r"zona oeste|oeste", "Zona Oeste"), (r"san martin|av\. san martín", "Av. San Martín"),
    (r"melchor pinto|av\. melchor pinto", "Av. Melchor Pinto"), (r"viedma|av\. viedma", "Av. Viedma"), (r"radial", "Radial"), (r"villa 1ro de mayo|primero de mayo", "Villa 1ro de Mayo"),
    (r"barrio", "Barrios"), (r"urb\.|urbanización", "Urbanizaciones"), (r"country|condominio", "Condominios"), (r"santa cruz de la sierra|santa cruz", "Santa Cruz"), (r"plaza", "Plaza"),
    (r"campero", "Campero"), (r"el palmar", "El Palmar"), (r"los lotes", "Los Lotes"), (r"pampa de la isla", "Pampa de la Isla"), (r"equipetrol sur", "Equipetrol Sur"), (r"plan 3000", "Plan 3000"),
]

# Property types by pattern, in order.
TYPE_RULES = [
    (r"departamento|depto|apartamento|apto", "Departamento"), (r"casa|chalet|bungalow", "Casa"), (r"terreno|lote|solar", "Terreno"), (r"oficina|local comercial|local|negocio", "Oficina/Local"),
    (r"galpón|depósito|almacén|bodega", "Galpón/Depósito"), (r"finca|quinta|hacienda|campestre", "Finca/Campestre"), (r"duplex|townhouse", "Duplex/Townhouse"), (r"penthouse|ático", "Penthouse"), (r"edificio|torre", "Edificio/Torre"),
]

# Zones and types that a question may name, in order.
ASKED_ZONES = [
    ("equipetrol", "equipetrol"), ("santa mónica", "santa mónica"), ("santa monica", "santa mónica"), ("urbari", "urbari"), ("los olivos", "los olivos"), ("zona norte", "zona norte"), ("zona sur", "zona sur"),
    ("zona este", "zona este"), ("zona oeste", "zona oeste"), ("urubó", "urubó"), ("urubo", "urubó"), ("centro", "centro"), ("el palmar", "el palmar"), ("el valle", "el valle"),
]
ASKED_TYPES = [("departamento", "departamento"), ("apartamento", "departamento"), ("casa", "casa"), ("penthouse", "penthouse"), ("terreno", "terreno"), ("local", "local"), ("oficina", "oficina")]

def zone_of(text: Column) -> Column:
    return once(F.lower(text), lambda low: first_match(low, ZONE_RULES))


def type_of(text: Column) -> Column:
    return once(F.lower(text), lambda low: first_match(low, TYPE_RULES))


def issues(titulo: Column, lat: Column, lng: Column, in_range: Column, precio: Column, zona: Column, tipo: Column) -> Column:
    """Names of what is wrong with a listing, in a fixed order."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return F.array_compact(F.array(
        F.when(blank(titulo), "Sin título"),
        F.when(lat.isNull() | lng.isNull() | (lat == 0) | (lng == 0), "Sin coordenadas").when(~in_range, "Coordenadas fuera de rango"),
        F.when(precio.isNull() | (precio <= 0), "Sin precio o precio inválido").when((precio < 1000) | (precio > 5_000_000), "Precio sospechoso"),
        F.when(blank(zona), "Sin zona"), F.when(blank(tipo), "Sin tipo de propiedad"),
    ))


def status(found: Column) -> Column:
    return F.when(F.size(found) == 0, "OK").when(F.size(found) <= 2, "WARNING").otherwise("ERROR")


def budget(text: Column) -> Column:
    """struct(min, max) from the numbers of a text: under 1000 counts in thousands; a fifth is left on both sides."""
    numbers = F.transform(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda n: n.try_cast("double"))
    usd = F.transform(F.filter(numbers, lambda n: n.isNotNull() & (n > 0)), lambda n: F.when(n < 1000, n * 1000).otherwise(n))
    return F.when(F.size(usd) > 0, F.struct((F.array_min(usd) * 0.8).alias("min"), (F.array_max(usd) * 1.2).alias("max")))
