"""Readers, column mapping and writers around the engine."""

from __future__ import annotations

import difflib
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers and the column they stand for.
ALIASES = {
    "titulo": "titulo", "título": "titulo", "title": "titulo", "precio": "precio", "precio usd": "precio", "price": "precio", "moneda": "moneda", "zona": "zona", "zone": "zona", "ubicacion": "direccion", "direccion": "direccion",
    "dirección": "direccion", "latitud": "latitud", "latitude": "latitud", "lat": "latitud", "longitud": "longitud", "longitude": "longitud", "lng": "longitud", "habitaciones": "habitaciones", "dormitorios": "habitaciones",
    "bedrooms": "habitaciones", "baños": "banos", "banos": "banos", "bathrooms": "banos", "garajes": "garajes", "superficie": "superficie", "sup. terreno": "superficie", "sup. construida": "superficie_construida",
    "descripción": "descripcion", "descripcion": "descripcion", "teléfono": "telefono", "url": "url",
}


def read_files(spark: SparkSession, folder: str, pattern: str = "*.parquet", recursive: bool = False) -> DataFrame:
    """All files of a folder, with the name of each row's file as ``archivo``."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.parquet(folder).select("*", F.col("_metadata.file_name").alias("archivo"))


def read_json_list(spark: SparkSession, path: str, element: str, keys: tuple[str, ...] = ("propiedades", "servicios", "services", "data")) -> DataFrame:
    """Elements of a JSON document that is a list, or an object with the list under one of ``keys``."""
    text = spark.read.text(path, wholetext=True)
    # an object read as an array would count as its one element
    bare = F.when(F.ltrim("value").startswith("["), F.col("value"))
    found = F.from_json(F.coalesce(bare, *[F.get_json_object("value", f"$.{k}") for k in keys]), f"array<{element}>")
    return text.select(F.explode(found).alias("e")).select("e.*")


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV, or TSV with ``sep``; quoted fields may run over lines."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, multiLine=True)


def read_tab_output(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Records of tab-separated query output, one file read whole for each row of files; all columns are texts.

    A record has as many fields as the first line; a line with another number
    is more of the last field of the record before it.
    """
    files = spark.read.text(path, wholetext=True).select(F.filter(F.split(F.trim("value"), "\n"), lambda line: F.trim(line) != "").alias("lines"))
    width = F.size(F.split(F.get("lines", F.lit(0)), "\t"))
    whole = lambda line: F.size(F.split(line, "\t")) == width
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: whole(F.get("lines", i)))
    at = files.where(F.size("lines") > 0).select("lines", F.posexplode(starts).alias("k", "start"), starts.alias("starts"))
    stop = F.coalesce(F.get("starts", F.col("k") + 1), F.size("lines"))
    more = F.transform(F.slice("lines", F.col("start") + 2, stop - F.col("start") - 1), lambda line: F.trim(line))
    fields = F.transform(F.split(F.get("lines", "start"), "\t"), lambda v: F.trim(v))
    rows = at.select(fields.alias("f"), more.alias("more"))
    return rows.select([(F.array_join(F.concat(F.array(F.get("f", F.lit(i))), "more"), "\n") if i == len(names) - 1 else F.get("f", F.lit(i))).alias(n) for i, n in enumerate(names)])


def read_table(spark: SparkSession, url: str, table: str, properties: dict[str, str], key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A database table, read in ``bounds`` = (low, high, parts) ranges of ``key`` if they are given."""
    if key and bounds:
        return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2], properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def standardise(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Columns under their canonical names; headers of one name are merged, the first that has a value."""
    targets: dict[str, list[str]] = {}
    for name in df.columns:
        targets.setdefault(aliases.get(name.strip().lower(), name), []).append(name)
    quoted = lambda n: F.col(f"`{n}`")
    return df.select([F.coalesce(*map(quoted, names)).alias(target) if len(names) > 1 else quoted(names[0]).alias(target) for target, names in targets.items()])


def find_column(columns: list[str], wanted: str, least: int = 70) -> tuple[str, int] | None:
    """The column that best fits a name: exact 100, contained 85, else likeness from ``least`` on."""
    plain = lambda s: "".join(ch for ch in unicodedata.normalize("NFD", s.lower().strip()) if not unicodedata.combining(ch))
    scores = [(100 if plain(c) == plain(wanted) else 85 if plain(wanted) in plain(c) or plain(c) in plain(wanted) else round(100 * difflib.SequenceMatcher(None, plain(c), plain(wanted)).ratio()), c) for c in columns if c.strip()]
    best = max(scores, key=lambda s: s[0], default=(0, ""))
    return (best[1], best[0]) if best[0] >= least else None


def profile(df: DataFrame, columns: list[str], samples: int = 10) -> DataFrame:
    """By column: numbers, texts, nulls, smallest and largest number, and a few values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor")) for c in columns])).alias("e")
    rows = df.select(each).select("e.*").withColumn("numero", F.col("valor").try_cast("double"))
    stats = rows.groupBy("columna").agg(F.count("numero").alias("numeros"), F.count_if(F.col("valor").isNotNull() & F.col("numero").isNull()).alias("textos"), F.count_if(F.col("valor").isNull()).alias("nulos"), F.min("numero").alias("desde"), F.max("numero").alias("hasta"))
    from pyspark.sql import Window

    few = rows.where("valor is not null").groupBy("columna", "valor").count().withColumn("r", F.row_number().over(Window.partitionBy("columna").orderBy("valor"))).where(F.col("r") <= samples)
    return stats.join(few.groupBy("columna").agg(F.array_sort(F.collect_list("valor")).alias("muestra")), "columna", "left")


def with_default_coordinates(df: DataFrame, lat: float, lng: float) -> DataFrame:
    """Coordinates filled in where one is missing, and whether both were there."""
    known = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return df.withColumn("coordenadas_validas", known).withColumn("lat", F.coalesce("lat", F.lit(lat))).withColumn("lng", F.coalesce("lng", F.lit(lng)))


def write_intermediate(df: DataFrame, folder: str, status: str = "status", first: tuple[str, ...] = ("status", "observaciones")) -> None:
    """Three outputs: the rows with their verdict first, the rows in error, and counts by verdict."""
    rows = df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])
    rows.write.mode("overwrite").parquet(f"{folder}/datos")
    rows.where(F.col(status) == "ERROR").write.mode("overwrite").parquet(f"{folder}/errores")
    rows.groupBy(status).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{folder}/resumen")


def write_sample(df: DataFrame, folder: str, columns: list[str], order: str, rows: int = 10) -> None:
    df.orderBy(order).limit(rows).select([c for c in columns if c in df.columns]).coalesce(1).write.mode("overwrite").csv(folder, header=True)


def export(df: DataFrame, folder: str, kind: str = "json") -> None:
    """Rows with nested fields flattened (parent_child), as json, csv or parquet."""

    def flat(schema, prefix: str = "", path: str = "") -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            if hasattr(f.dataType, "fields"):
                out += flat(f.dataType, f"{prefix}{f.name}_", f"{path}`{f.name}`.")
            else:
                out.append(F.col(f"{path}`{f.name}`").alias(prefix + f.name))
        return out

    rows = df.select(flat(df.schema))
    getattr(rows.write.mode("overwrite"), kind)(folder, **({"header": True} if kind == "csv" else {}))


def insert_statements(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One INSERT for each row; quotes in texts are doubled."""
    value = lambda c: F.coalesce(F.when(F.lit(dict(df.dtypes)[c] == "string"), F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.col(c).cast("string")), F.lit("NULL"))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ("), F.concat_ws(", ", *[value(c) for c in columns]), F.lit(") ON CONFLICT DO NOTHING;")).alias("sentencia"))


def backup(df: DataFrame, folder: str) -> None:
    df.write.mode("errorifexists").parquet(folder)


def append_log(spark: SparkSession, folder: str, process: str, processed: int, errors: int, at: str) -> None:
    spark.createDataFrame([(process, processed, errors, at)], "proceso string, procesados long, errores long, momento string").coalesce(1).write.mode("append").json(folder)


def missing_tables(spark: SparkSession, expected: list[str]) -> list[str]:
    """Expected tables that the catalog lacks."""
    there = {t.name for t in spark.catalog.listTables()}
    return sorted(set(expected) - there)


def catalog_report(spark: SparkSession, tables: list[str], functions: list[str]) -> DataFrame:
    """(clase, nombre, existe, filas) of the tables and functions that a migration must have; rows are counted for tables that are there."""
    named = {f.name.rpartition(".")[2] for f in spark.catalog.listFunctions()}
    missing = set(missing_tables(spark, tables))
    found = [("tabla", t, t not in missing, None if t in missing else spark.table(t).count()) for t in tables]
    return spark.createDataFrame(found + [("funcion", f, f in named, None) for f in functions], "clase string, nombre string, existe boolean, filas long")
