"""The operators as steps from documents to documents: each applies its decisions and keeps the columns it was given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, join_few, materialize, unused
from predio.llm.jaccard import jaccard_components
from predio.llm.linededup import remove_shared_lines
from predio.llm.mixing import mix_sources
from predio.llm.quality import METADATA, quality_scores, row_key

_NO_ID = -(1 << 63)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the quality classifier accepts; the texts of the others alone can be moved."""
    scored = quality_scores(docs, labels)
    (key,) = unused(docs.columns, "row_key")
    bad = materialize(scored.where("quality_keep = 0").select(F.col("row_key").alias(key)).distinct(), "rejected")
    return join_few(docs.withColumn(key, row_key(docs, metadata=METADATA)), bad, key, "left_anti").select(docs.columns)


def cut_shared_lines(docs: DataFrame, min_sites: int = 8, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents without the lines that many sites share; n_chars, if there is one, follows the text.

    A group of near copies, as ``keep_one_of_each`` finds it, is one site:
    else its copies would empty each other, and none would be left to keep.
    """
    groups = jaccard_components(docs, width=width, percent=percent)
    classes = materialize(groups.groupBy("doc_id").agg(F.min("component_id").alias("class")), "line-groups")
    lines, cut = unused(docs.columns, "lines", "cut")
    out = remove_shared_lines(docs, min_sites=min_sites, counts=(lines, cut), classes=classes)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document, that of the smallest id, of every group of near copies; documents without an id stay.

    An id that several rows share stays with all of them if one of its rows
    stands for a group.
    """
    groups = jaccard_components(docs, width=width, percent=percent)
    stays = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = materialize(stays.where("not stays").select(F.col("doc_id")), "dropped-ids")
    return join_few(docs, gone, "doc_id", "left_anti").select(docs.columns)


def repeat_as_mixed(docs: DataFrame, **parameters) -> DataFrame:
    """Every document as often as the mix takes it, so not at all if it takes none.

    Rows are told apart by all their columns.  Only rows equal in every one
    are taken for each other: one of them is repeated as often as all of them
    together are, and they alone are gathered for that.  Beyond the size of a
    broadcast this moves the documents once, by id.
    """
    no, key, source, copies, rows = unused(docs.columns, "id", "key", "site", "copies", "rows")
    hashed = [F.col(f.name) if not f.dataType.simpleString().startswith("map") else F.to_json(f.name) for f in docs.schema.fields]
    whole = F.xxhash64(*hashed, F.concat(*[c.isNull().cast("int").cast("string") for c in hashed]))  # a null adds nothing to a hash of several columns
    mix = mix_sources(docs, row_key=whole, **parameters).groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias(no), F.col("row_key").alias(key), F.coalesce("source", F.lit("\u0000")).alias(source))
    mix = materialize(mix.agg(F.sum("copies").alias(copies), F.count("*").alias(rows)), "mix-copies")
    keyed = docs.withColumn(key, whole).withColumn(no, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn(source, F.coalesce(F.col("source").cast("string"), F.lit("\u0000")))
    by, taken = [no, key, source], mix.where(F.col(copies) > 0)
    out = keyed.join(checked_broadcast(taken.where(F.col(rows) == 1).drop(rows)), by)
    again = taken.where(F.col(rows) > 1).drop(rows)
    if not again.isEmpty():
        out = out.unionByName(keyed.join(checked_broadcast(again), by).dropDuplicates(by))
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(no)).select(docs.columns)
