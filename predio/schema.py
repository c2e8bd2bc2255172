"""Canonical entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROPERTIES = """
id long, agente_id long, titulo string, descripcion string, tipo_propiedad string, estado_propiedad string,
precio_usd decimal(12,2), precio_usd_m2 decimal(10,2), moneda string, direccion string, zona string, uv string,
manzana string, lote string, superficie_total decimal(10,2), superficie_construida decimal(10,2),
num_dormitorios int, num_banos int, num_garajes int, lat double, lng double, coordenadas_validas boolean,
datos_completos boolean, fecha_publicacion timestamp, fecha_scraping timestamp, ultima_actualizacion timestamp,
proveedor_datos string, codigo_proveedor string, url_origen string"""

SERVICES = """
id long, nombre string, categoria_principal string, subcategoria string, direccion string, zona string, uv string,
manzana string, zona_uv string, lat double, lng double, telefono string, horario string, email string, web string,
fuente_origen string, coordenadas_validadas boolean, confidence_calificacion decimal(3,2)"""

AGENTS = "id long, nombre string, telefono string, email string, empresa string, fecha_registro timestamp"

# Service categories with their priority.
CATEGORIES = [("educacion", 1), ("salud", 1), ("comercio", 2), ("transporte", 2), ("seguridad", 1), ("recreacion", 3), ("finanzas", 2), ("gobierno", 3), ("otros", 4)]

# Codes of the data providers.
PROVIDERS = ["01", "02", "03", "04", "05"]

# The bounding boxes in use (lat_min, lat_max, lng_min, lng_max).
BOX_LOAD = (-18.5, -17.5, -63.5, -63.0)
BOX_RAW = (-18.2, -17.5, -63.5, -63.0)
BOX_AUDIT = (-18.5, -17.0, -64.0, -62.5)

# Where listings without coordinates are put, and bolivianos to a dollar.
DEFAULT_LNG, DEFAULT_LAT = -63.1833, -17.7833
BOB_PER_USD = 6.96


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "categoria string, prioridad int")
