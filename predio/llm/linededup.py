"""Removal of lines that stand on many distinct sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, discard, join_few, materialize


def boilerplate_lines(lines: DataFrame, min_sites: int, *, lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """Keys (h1, h2) of the lines on at least ``min_sites`` distinct sites; ``lines`` has h1, h2, site.

    Sites are counted with one HyperLogLog sketch per line, merged by the
    aggregation itself.  Lines whose estimate lies within ``band`` of the
    threshold are counted exactly; further off, the sketch (standard error
    under 2 % at the default size) decides.
    """
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n")).where(F.col("n") >= min_sites)
    sketched = materialize(sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - band)), "line-sites")
    near = sketched.where(F.col("estimate") <= min_sites * (1 + band)).select("h1", "h2")
    exact = lines.join(checked_broadcast(near), ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sketched.where(F.col("estimate") > min_sites * (1 + band)).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def _one_site_a_class(keyed: DataFrame, classes: DataFrame | None) -> DataFrame:
    """``keyed`` with the smallest site of its class as each row's site; rows of equal text are of one class, with or without ``classes``."""
    same = F.xxhash64("text").alias("same")
    if classes is None:
        sites = keyed.groupBy(same).agg(F.min("site").alias("one_site"), F.max("site").alias("high"))
        moved = materialize(sites.where("one_site != high").select("same", "one_site"), "text-sites")
    else:
        by_id = keyed.select("id", "site", same).join(classes, "id", "left")
        of_text = F.coalesce("class", F.concat(F.lit("text "), F.col("same").cast("string")))
        texts = materialize(by_id.groupBy("same").agg(F.min(of_text).alias("class"), F.min("site").alias("low"), F.max("site").alias("high")), "line-classes")
        sites = materialize(texts.groupBy("class").agg(F.min("low").alias("one_site"), F.max("high").alias("high")).where("one_site != high").select("class", "one_site"), "class-sites")
        moved = materialize(texts.join(checked_broadcast(sites), "class").select("same", "one_site"), "text-sites")
        discard(texts, sites)
    return join_few(keyed.withColumn("same", same), moved, "same", "left").withColumn("site", F.coalesce("one_site", "site"))


def remove_shared_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8, counts: tuple[str, str] = ("n_lines", "n_removed"), classes: DataFrame | None = None) -> DataFrame:
    """``docs`` with the lines that stand on ``min_sites`` or more distinct sites cut from the text.

    Lines end at line feeds and are compared without their outer spaces;
    blank ones always stay.  A null site counts as one site of its own kind.
    Rows of equal text count as one site, the smallest of theirs, so that
    copies of one document alone never make its lines shared; else they would
    empty each other.  With ``classes`` (``id_col``, class: the groups of near
    copies by id) a whole group of near copies counts as one site too.
    Adds the two ``counts`` (0 for a null text, which stays null); columns that
    had these names are replaced.  Rows
    with the same id are edited alike only if their texts are equal, as each
    row is keyed by id and text.  All other columns pass through; an empty
    table stays empty.
    """
    names = [c for c in docs.columns if c not in counts]
    keyed = docs.select(F.struct(*names).alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(site_col).cast("string"), F.lit("\u0000")).alias("site"))
    keyed = keyed.withColumn("key", F.xxhash64("id", "text")).withColumn("lines", F.split("text", "\n", -1))
    groups = None if classes is None else classes.select(F.col(id_col).cast("string").alias("id"), F.col("class").cast("string").alias("class"))
    sited = _one_site_a_class(keyed, groups)
    line = F.trim("line")
    lines = materialize(
        sited.select("key", "site", F.posexplode("lines").alias("pos", "line")).where(line != "").select("key", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")), "lines"
    )
    shared = materialize(boilerplate_lines(lines.select("h1", "h2", "site"), min_sites), "shared-lines")
    cut = lines.join(checked_broadcast(shared), ["h1", "h2"], "left_semi").select("key", "pos").distinct().groupBy("key").agg(F.collect_list("pos").alias("cut"))
    kept = F.filter("lines", lambda line, i: ~F.array_contains("cut", i))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    cut = materialize(cut, "cut-lines")
    discard(lines, shared)
    out = join_few(keyed, cut, "key", "left", row_bytes=64 + 4 * F.size("cut"))
    return out.select(
        *[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias(counts[1]),
    )
