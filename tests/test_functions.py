"""Literal cases of the parsers and extractors."""

import pytest
from pyspark.sql import functions as F

from predio.functions import cleansing as c
from predio.functions import extraction as x
from predio.functions import geo
from predio.schema import BOX_LOAD, BOX_RAW


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("$150,000", 150000.0), ("USD 150.000", 150.0), ("150000", 150000.0), ("200.000,50", 200000.5), ("1,234,567", 1234567.0), ("12,5", 12.5), (None, None), ("no válido", None), ("nan", None), ("", None)])
def test_price(spark, text, want):
    assert one(spark, text, c.parse_price) == want


@pytest.mark.parametrize(("text", "want"), [("$150,000", 150000.0), ("USD 150.000", 150000.0), ("150000", 150000.0), ("no válido", None)])
def test_price_with_thousands(spark, text, want):
    assert one(spark, text, c.parse_price_thousands) == want


@pytest.mark.parametrize(("text", "want"), [("3", 3), ("3.5", 3), ("-3.9", -3), ("3,5", 3), (None, None), ("texto", None)])
def test_number(spark, text, want):
    assert one(spark, text, c.parse_number) == want


def test_number_with_thousands(spark):
    assert one(spark, "3,000", c.parse_number_thousands) == 3000 and one(spark, "3,5", c.parse_number_thousands) == 3


@pytest.mark.parametrize(("text", "want"), [("  Hola  ", "Hola"), ("", ""), (None, ""), ("nan", ""), ("a\x00b \t c", "ab c"), ("MarÃ­a", "María")])
def test_clean(spark, text, want):
    assert one(spark, text, c.clean_text) == want


def test_nfc(spark):
    assert one(spark, "é", c.nfc) == "é" and one(spark, None, c.nfc) is None


def test_price_in_usd(spark):
    assert one(spark, "Bs. 696", lambda v: c.price_in_usd(v)["usd"]) == pytest.approx(100)
    assert one(spark, "nada", lambda v: c.price_in_usd(v)["usd"]) == 0.0 and one(spark, None, lambda v: c.price_in_usd(v)["usd"]) == 0.0


@pytest.mark.parametrize(("text", "want"), [("2025-01-15", "2025-01-15"), ("15/01/2025", "2025-01-15"), ("2025.01.15", "2025-01-15"), ("x", None), (None, None)])
def test_date(spark, text, want):
    assert one(spark, text, lambda v: F.date_format(c.parse_date(v), "yyyy-MM-dd")) == want


@pytest.mark.parametrize(("text", "want"), [("2025.01.15 data.xlsx", "2025.01.15"), ("2025-01-15.xlsx", None)])
def test_file_date(spark, text, want):
    assert one(spark, text, c.file_date) == want


@pytest.mark.parametrize(("text", "want"), [("Hermosa casa en venta", "Casa"), ("Departamento amplio", "Departamento"), ("Lote 5", "Terreno"), ("Oficina", "Oficina/Local"), ("Penthouse", "Penthouse"), ("nada", None)])
def test_type(spark, text, want):
    assert one(spark, text, c.type_of) == want


def test_zone_order(spark):
    assert one(spark, "Equipetrol Sur", c.zone_of) == "Equipetrol" and one(spark, "zona oeste", c.zone_of) == "Zona Este"


@pytest.mark.parametrize(
    ("lat", "lng", "want"),
    [(-17.7833, -63.1821, (-17.7833, -63.1821, "validas")), (-63.1821, -17.7833, (-17.7833, -63.1821, "invertidas")), (-177833.0, -6318210.0, (-17.7833, -63.1821, "normalizadas")), (17.7833, 63.1821, (-17.7833, -63.1821, "signos")), (-25.0, -70.0, (-25.0, -70.0, "fuera")), (0.0, -63.1, (None, None, "vacias"))],
)
def test_coordinates(spark, lat, lng, want):
    r = spark.createDataFrame([(lat, lng)], "a double, b double").select(geo.repair_coordinates(F.col("a"), F.col("b"), BOX_RAW).alias("r")).first()["r"]
    assert (r.lat and round(r.lat, 6), r.lng and round(r.lng, 6), r.how) == want


def test_box(spark):
    assert one(spark, -17.7833, lambda v: geo.in_box(v, F.lit(-63.1821), BOX_LOAD), "double") is True
    assert one(spark, -25.0, lambda v: geo.in_box(v, F.lit(-63.1821), BOX_LOAD), "double") is False


def test_extraction(spark):
    text = "Precio: $us 400.000.- Casa en venta, 3 dormitorios, 2.5 baños, cochera, superficie: 250 m2, 4to anillo y radial 13, piscina. Contacto: 70012345"
    get = lambda fn: one(spark, text, fn)
    assert get(x.price) == 400000.0 and get(x.currency) == "USD" and get(x.surface) == 250.0 and get(x.rooms) == 3 and get(x.baths) == 2.5 and get(x.garages) == 1
    assert get(x.rings) == [4] and get(x.radials) == [13] and get(x.amenities) == ["piscina"] and get(x.operation) == "venta" and get(x.contact) == "70012345"
    assert one(spark, "sup. 3.5x2.5", x.surface) == 8.75 and one(spark, "Bs. 550 mensuales", x.price) == 550.0 and one(spark, "400bs", x.currency) == "BOB"


@pytest.mark.parametrize(
    ("text", "price", "currency"),
    [
        ("Precio: $us 400.000.-", 400000.0, "USD"), ("$1.757.200", 1757200.0, "USD"), ("Bs. 550 mensuales", 550.0, "BOB"), ("660 Bs", 660.0, "BOB"), ("$ 500 o us$ 450", 500.0, "USD"), ("us$ 450.000", 450000.0, "USD"),
        ("450.000us", 450000.0, "USD"), ("400bs", 400.0, "BOB"), ("5000 bolivianos", 5000.0, "BOB"), ("venta en 350000", 350000.0, "USD"), ("alquiler 500 bs, uso comercial", 500.0, "BOB"), ("busco casa 700 bs", 700.0, "BOB"),
        ("pago en dólares", None, "USD"), ("sin datos", None, "USD"), (None, None, "USD"),
    ],
)
def test_text_price_and_currency(spark, text, price, currency):
    assert one(spark, text, x.price) == price and one(spark, text, x.currency) == currency


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Superficie: 2.500 m2", 2500.0), ("superficie construida: 12 m", 12.0), ("1.234,5 m2", 1234.5), ("1.234.567 mt2", 1234567.0), ("superficie: 1.234,5 m2", 1234.5), ("16 m²", 16.0), ("12,5 m2", 12.5), ("sup. 3.5x2.5, terreno de 200 m", 8.75),
        ("sup.(6.50x3.25)", 21.13), ("250 mt2", 250.0), ("lote 300m", 300.0), ("área construida 120 m", 120.0), ("nada", None), (None, None),
    ],
)
def test_text_surface(spark, text, want):
    assert one(spark, text, x.surface) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Agente: ana paz, zona sur", "Ana Paz"), ("celular: 70012345", "70012345"), ("tel: 3-456789", "3-456789"), ("Correo: a@b.bo", "A@b.bo"), ("citi inmuebles ofrece", "Citi Inmuebles"), ("propiedades urbanas srl", "Propiedades Urbanas"),
        ("grupo sol inmobiliario", "Grupo Sol Inmobiliario"), ("informes con juan", "Juan"), ("agente: xy, contactar a luis", "Luis"), ("casa amplia", None), (None, None),
    ],
)
def test_agent(spark, text, want):
    assert one(spark, text, x.agent) == want


def test_price_candidates_equal_a_plain_loop(spark, sf_dir):
    import re

    from predio.functions import enrichment as e
    from predio.plans import registered
    from predio.sources.views import crudos

    got = {}
    for r in registered()[0]["x29_price_candidates"](spark, sf_dir).collect():
        got.setdefault(r.id, []).append((r.precio, r.texto))
    for r in crudos(spark, sf_dir).select("id", "descripcion").collect():
        want = []
        for pattern in e.CANDIDATES:
            for found in re.findall(f"(?=({pattern}))", r.descripcion.lower()):
                digits = found[1].replace(",", "")
                if re.fullmatch(r"\d+(\.\d*)?|\.\d+", digits) and float(digits) >= 10:
                    want.append(float(digits))
        mine = [p for p, _ in got.get(r.id, [])]
        assert set(mine) <= set(want) and (bool(mine) == (r.id % 4 != 3)) and all(t in r.descripcion.lower() for _, t in got.get(r.id, []))


def test_budget(spark):
    r = one(spark, "entre 100 y 200000 usd", c.budget)
    assert (r["min"], r["max"]) == (80000.0, 240000.0) and one(spark, "sin números", c.budget) is None


def test_needs(spark):
    assert one(spark, ["Prestigio", "x"], x.needs_to_categories, "array<string>") == ["educacion", "salud"]
    assert one(spark, ["x"], x.needs_to_categories, "array<string>") == x.DEFAULT_NEEDS


def test_every_listing_is_corrected(spark, sf_dir):
    from predio.plans import registered
    from predio.sources.views import crudos

    queries = registered()[0]
    got = {r.id: r.corregido for r in queries["x31_price_correction_all"](spark, sf_dir).collect()}
    total = {r.o_orderkey: int(r.o_totalprice) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()}
    form = {0: lambda p: f"{p:,.2f} USD", 1: lambda p: f"{p % 9000 + 500:,.2f} BOB", 2: lambda p: f"{p:,.2f} {'USD' if p > 10_000 else 'BOB'}", 3: lambda p: None}
    assert set(got) == {r.id for r in crudos(spark, sf_dir).select("id").collect()}
    wrong = {k % 4: (v, form[k % 4](total[k])) for k, v in got.items() if v != form[k % 4](total[k])}
    assert not wrong


def test_agents_of_different_names_stay_apart(spark, sf_dir):
    from predio.plans import registered
    from predio.sources.views import agentes

    queries = registered()[0]
    names = [r.nombre.strip().lower() for r in agentes(spark, sf_dir).collect()]
    merged = queries["a29_agent_merge_names"](spark, sf_dir).collect()
    assert sorted(r.clave for r in merged) == sorted(set(names)) and sum(r.n for r in merged) == len(names)


def test_plain_texts_are_found_as_the_pattern_finds_them(spark):
    from functools import reduce

    from predio.functions import cleansing as c

    texts = ["oeste", "Zona SUR", "av. san martín", "avxsan martín", "urb. sol", "urbx", "plaza principal", "santa cruz de la sierra", "equipetrol sur", "radial 13", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules, fn in ((c.ZONE_RULES, c.zone_of), (c.TYPE_RULES, c.type_of)):
        low = F.lower("t")
        want = reduce(lambda acc, r: acc.when(low.rlike(r[0]), r[1]), rules[1:], F.when(low.rlike(rules[0][0]), rules[0][1]))
        assert [tuple(r) for r in rows.select(want, fn(F.col("t"))).collect() if r[0] != r[1]] == []
    mixed = [(r"a\d+", "digits"), (r"b\.c|xb\.c", "dot")]
    got = spark.createDataFrame([("a1",), ("b.c",), ("bxc",), (None,)], "t string").select(c.first_match(F.col("t"), mixed)).collect()
    assert [r[0] for r in got] == ["digits", "dot", None, None]
