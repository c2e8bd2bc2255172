"""Queries without SQL against plain Python over the same rows."""

import difflib
import random
import re

import pytest

from predio.functions import enrichment as e
from predio.functions import extraction as x
from predio.operators.duplicates import greedy, scored_pairs
from predio.operators.similar import similar_candidates
from predio.plans import registered
from predio.plans.resolution import entered, people
from predio.plans.scoring import QUESTIONS
from predio.sources.views import agentes, crudos, propiedades

QUERIES = registered()[0]


def plain(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (text or "").lower())).strip()


MATCHERS = {}


def ratio(a, b):
    if not a or not b:
        return 0.0
    if b not in MATCHERS:
        MATCHERS[b] = difflib.SequenceMatcher(None, "", b)
    MATCHERS[b].set_seq1(a)
    return MATCHERS[b].ratio()


def test_title_similarity(spark, sf_dir):
    want = {r.id: ratio(plain(r.titulo), plain(f"1-URGENT en {r.zona}")) for r in propiedades(spark, sf_dir).collect()}
    assert {r.id: r.parecido for r in QUERIES["x39_title_similarity"](spark, sf_dir).collect()} == pytest.approx(want, abs=1e-6)


def one_agent(x, y):
    """The rule by which two records are of one agent, in its own words."""
    if x.email and y.email and x.email == y.email:
        return "correo"
    if x.telefono and y.telefono and x.telefono == y.telefono:
        return "teléfono"
    alike = ratio(plain(x.nombre), plain(y.nombre))
    if alike > 0.8 and ((x.email and y.email) or (x.telefono and y.telefono)):
        return "nombre y contacto"
    if alike > 0.95:
        return "nombre"
    if alike > 0.7 and x.empresa and x.empresa == y.empresa:
        return "nombre y empresa"
    return None


def test_same_agent(spark):
    rows = sorted(people(spark, "/root/testdata/sf0.01").where("id <= 700").collect(), key=lambda r: r.id)
    want = {(x.id, y.id): rule for i, x in enumerate(rows) for y in rows[i + 1 :] if (rule := one_agent(x, y))}
    got = {(r.a, r.b): r.regla for r in QUERIES["x42_same_agent"](spark, "/root/testdata/sf0.01").collect()}
    assert {k: v for k, v in got.items() if k[1] <= 700} == want
    assert set(want.values()) == {"correo", "teléfono", "nombre y contacto", "nombre", "nombre y empresa"}


def places(x, y):
    if not (x.lat and x.lng and y.lat and y.lng):
        return 0.0
    dy, dx = abs(x.lat - y.lat) * 111320, abs(x.lng - y.lng) * 111320 * abs(x.lat) / 90
    metres = (dx * dx + dy * dy) ** 0.5
    return 1.0 if metres < 100 else 0.8 if metres < 500 else 0.5 if metres < 1000 else 0.0


def duplicate(x, y, tx, ty):
    """(score, reason) of two listings, or None; every part is worked out for every pair."""
    title, place = ratio(tx, ty), places(x, y)
    price = max(0, 1 - abs(x.precio_usd - y.precio_usd) / ((x.precio_usd + y.precio_usd) / 2)) if x.precio_usd and y.precio_usd else 0.0
    same = [bool(x.dormitorios and x.dormitorios == y.dormitorios), bool(x.banos and x.banos == y.banos), bool(x.superficie and y.superficie and abs(x.superficie - y.superficie) / ((x.superficie + y.superficie) / 2) < 0.1)]
    zone = 1.0 if x.zona and y.zona and x.zona.lower() == y.zona.lower() else 0.0
    score = (title * 0.7 + price * 0.6 + place * 0.8 + sum(same) / 3 * 0.5 + zone * 0.4) / 3
    if title > 0.8 and price > 0.9:
        return score, "Título y precio muy similares"
    if title > 0.6 and place > 0.8:
        return score, "Título similar y coordenadas idénticas"
    if score > 0.75:
        return score, "Coordenadas exactamente iguales" if place > 0.9 else "Precio exactamente igual" if price > 0.95 else "Múltiples características similares"
    return None


def all_duplicates(rows):
    rows = sorted((r for r in rows if r.url), key=lambda r: r.id)
    titles = [plain(r.titulo) for r in rows]
    return {(x.id, y.id): found for i, x in enumerate(rows) for j, y in enumerate(rows[i + 1 :], i + 1) if x.url != y.url and (found := duplicate(x, y, titles[i], titles[j]))}


def one_pass(pairs):
    """What a pass by id keeps: a listing matched before is skipped."""
    gone, out = set(), set()
    for a, b in sorted(pairs):
        if a not in gone and b not in gone:
            out.add((a, b))
            gone.add(b)
    return out


def test_scored_duplicates(spark, sf_dir):
    """Given listings with their second entries, every pair."""
    df = entered(spark, sf_dir).where("id % 10000000 <= 450")
    want = all_duplicates(df.collect())
    pairs = scored_pairs(df)
    got = {(r.a, r.b): (r.puntaje, r.motivo) for r in pairs.collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(v[1] == want[k][1] and abs(v[0] - want[k][0]) < 1e-9 for k, v in got.items())
    assert {(r.a, r.b) for r in greedy(pairs).collect()} == one_pass(want)
    whole = {(r.a, r.b): r.motivo for r in QUERIES["j17_scored_duplicates"](spark, sf_dir).collect()}
    assert whole.items() >= {k: v[1] for k, v in want.items()}.items()
    assert {(r.a, r.b) for r in QUERIES["j17_scored_greedy"](spark, sf_dir).collect()} == one_pass(whole)


def test_scored_duplicates_of_made_listings(spark):
    """Texts from none to long, points from the equator to the pole, gaps and zeros everywhere."""
    rng = random.Random(11)
    bases = ["", "a", "ab", "casa", "Casa en venta", "Departamento 2 dormitorios, Equipetrol!", "Terreno en la zona norte con todos los servicios y papeles al día", "xyz " * 60]
    rows = []
    for i in range(420):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t) + 1) : rng.randrange(len(t) + 1)] = rng.choice(["", "x", "ñ", " 9"])
        lat = rng.choice([0.0, 0.001, -0.004, -17.8, -17.8, 64.2, None])
        near = rng.choice([0, 0.0003, 0.003, 0.02, 0.4])
        rows.append((i, rng.choice([None, "u1", "u2", *[f"u{i}"] * 8]), rng.choice(["".join(t), None]) if rng.random() < 0.1 else "".join(t), rng.choice([None, 0.0, 100_000.0, 104_000.0, 109_000.0, 111_000.0, 150_000.0]),
                     None if lat is None else lat + rng.random() * near / 10, rng.choice([-63.2, 0.0, 20.0]) + rng.random() * near, rng.choice([None, "", "Norte", "NORTE", "sur"]), rng.choice([None, 0, 2, 3]), rng.choice([0, 1, 2]), rng.choice([None, 0.0, 100.0, 105.0])))
    df = spark.createDataFrame(rows, "id long, url string, titulo string, precio_usd double, lat double, lng double, zona string, dormitorios int, banos int, superficie double")
    want = all_duplicates(df.collect())
    got = {(r.a, r.b): (r.puntaje, r.motivo) for r in scored_pairs(df).collect()}
    assert got.keys() == want.keys() and {m for _, m in want.values()} >= {"Título y precio muy similares", "Título similar y coordenadas idénticas", "Coordenadas exactamente iguales"}
    assert all(v[1] == want[k][1] and abs(v[0] - want[k][0]) < 1e-9 for k, v in got.items())
    assert scored_pairs(df.where("false")).count() == 0


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_candidates_lose_no_similar_pair(spark, percent):
    rng = random.Random(percent)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(12))).strip() for _ in range(160)] + ["".join(rng.choice("abcdefghij ") for _ in range(40)) for _ in range(5)]
    texts += [t[:i] + rng.choice("axz") + t[i + rng.randrange(2) :] for t in texts for i in [rng.randrange(len(t) + 1)]]
    got = {(r.a, r.b) for r in similar_candidates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), percent).collect()}
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts[i + 1 :], i + 1) if ratio(x, y) > percent / 100}
    assert want <= got and len(got) < len(texts) ** 2 / 2


def test_found_fields(spark, sf_dir):
    d = "descripcion"
    single = [f(d).alias(f.__name__) for f in map(_column, (x.price, x.surface, x.rooms, x.baths, e.zone_name, x.garages, x.operation, x.agent, x.contact, x.rings, x.amenities))]
    want = {r[0]: 1 + sum(bool(v) or v == 0 for v in r[1:] if v != []) for r in crudos(spark, sf_dir).select("id", *single).collect()}
    assert {r.id: r.campos for r in QUERIES["x28_found_fields"](spark, sf_dir).collect()} == want


def _column(f):
    from pyspark.sql import functions as F

    def on(name):
        return f(F.col(name))

    on.__name__ = f.__name__
    return on


def test_answers_and_briefing(spark, sf_dir):
    zones = ("Centro", "Zona Norte", "Zona Sur", "Equipetrol", "Urbari")
    rows = [(zones[r.id % 5], r.precio_usd or 0) for r in propiedades(spark, sf_dir).select("id", "precio_usd").collect()]
    got = {r.consulta: r for r in QUERIES["r15_question_answers"](spark, sf_dir).collect()}
    assert set(got) == set(QUESTIONS)
    count = lambda z: sum(1 for name, _ in rows if name == z)
    assert got[QUESTIONS[2]].n == count("Zona Sur") and got[QUESTIONS[3]].n == count("Equipetrol") and got[QUESTIONS[4]].n == count("Urbari") and got[QUESTIONS[5]].tipo == "ayuda"
    prices = sorted((p for name, p in rows if name == "Centro" and p > 0), reverse=True)[:5]
    assert [line.split(" USD")[0] for line in got[QUESTIONS[0]].respuesta.split("\n")] == [f"${p:,.0f}" for p in prices]
    ranked = QUERIES["r18_chat_search"](spark, sf_dir).collect()
    assert 0 < len(ranked) <= 3 and [r.compatibilidad for r in ranked] == sorted((r.compatibilidad for r in ranked), reverse=True)
    text = QUERIES["r19_briefing"](spark, sf_dir).first().texto.split("\n")
    assert text[0] == "Resumen de opciones" and 1 < len(text) <= 4 and all(line.startswith("- ") for line in text[1:])
