"""The operators bound to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, materialize
from predio.llm.filteraudit import audit_filters
from predio.llm.jaccard import jaccard_components
from predio.llm.language import identify
from predio.llm.linededup import remove_shared_lines
from predio.llm.mixing import mix_sources
from predio.llm.packing import pack
from predio.llm.quality import quality_scores
from predio.llm.secretscan import scan_secrets
from predio.llm.sharding import shard_by_bytes
from predio.llm.simhash import fingerprint_edits, near_counts, near_pairs
from predio.llm.spelling import thinned_words, variant_groups
from predio.llm.toxicity import held_out, toxicity
from predio.llm.vectors import range_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files(name: str = "byte_bpe_50k") -> dict[str, str]:
    """Where the public vocabulary lies; the same one as a tokenizer file and as merge ranks."""
    import public_tokenizers

    return {"tokenizer_json": public_tokenizers.path(f"{name}.json"), "rank_file": public_tokenizers.path(f"{name}.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), **tokenizer_files(), with_ids=False)


def op2_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT doc_id, text, min(coalesce(source, chr(1))) OVER (PARTITION BY text) AS site FROM documents)),
shared AS (
  SELECT trim(line) AS k FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 8),
marked AS (
  SELECT doc_id, pos, line, s.k IS NOT NULL AS cut FROM lines LEFT JOIN shared s ON trim(line) = s.k),
made AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE m.text END AS text
FROM documents d LEFT JOIN made m USING (doc_id)
"""


def op4_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct([hash(array_to_string(w[i : i + 2], ' ')) FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words),
flat AS (SELECT doc_id, unnest(s) AS t, len(s) AS n FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 90 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


def op5_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = materialize(fingerprint_edits(table(spark, sf_dir, "documents")), "op5")
    fp = F.conv("fingerprint", 16, -10).cast("long")
    # most fingerprints are near no other: only the rest are joined, so copies of one text meet no large side
    near = materialize(near_counts(marks.select(fp.alias("fp")), radius=3).where("n_near > 0"), "op5-near")
    joined = marks.withColumn("fp", fp).join(checked_broadcast(near), "fp", "left")
    return joined.select(*marks.columns, F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op5_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct fingerprints within 10 bits; op5_simhash_fingerprints tells their documents, and its n_near counts those within 3."""
    marks = materialize(fingerprint_edits(table(spark, sf_dir, "documents")).select("fingerprint"), "op5-links")
    pairs = near_pairs(marks.select(F.conv("fingerprint", 16, -10).cast("long").alias("fp")), radius=10, blocks=12)
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return pairs.select(text("fp").alias("fingerprint"), text("other").alias("other"), "distance")


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_fused_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"), 0.98)


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN embedding IF c <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
component AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(c.y, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(c.y, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.x = e.vec_id LEFT JOIN component c ON c.x = e.vec_id
"""


def op10_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "metadata_score", F.col("quality_score").alias("score"), F.col("quality_keep").alias("keep"))


def op11_bit_sliced_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(thinned_words(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each_run AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || [('0x' || b[2 * i - 1 : 2 * i])::BIGINT FOR i IN range(1, len(b) // 2 + 1)], lambda c, x: xor(c >> 8, crc.t[xor(c & 255, x) + 1])), 4294967295) AS h
  FROM each_run, crc),
thinned AS (SELECT CASE WHEN h % 199 = 0 THEN run[: h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT DISTINCT word, n, i, word[: i] || word[i + 2 :] AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND len(a.word) = len(b.word)
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
ranked AS (SELECT x, y, w.n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY w.n DESC, y) AS k FROM pairs JOIN words w ON w.word = y),
formed AS (
  SELECT w.word, CASE WHEN r.n >= 5 * w.n THEN r.y END AS form, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.x = w.word AND r.k = 1),
chain(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.*, c.root FROM formed f JOIN chain c USING (word) JOIN formed last ON last.word = c.root AND last.form IS NULL
"""


def op12_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS owner, coalesce(doc_id::VARCHAR, '-') AS repo FROM documents),
cut AS (
  SELECT r, owner, repo, 'assign' AS kind, 0 AS k, regexp_extract_all(t, p, 2) AS v, regexp_extract_all(t, p) AS m, string_split_regex(t, p) AS g
  FROM (SELECT *, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p FROM d)
  UNION ALL SELECT r, owner, repo, 'access', 1, regexp_extract_all(t, p), regexp_extract_all(t, p), string_split_regex(t, p) FROM (SELECT *, 'AKIA[A-Z0-9]+' AS p FROM d)
  UNION ALL SELECT r, owner, repo, 'hex', 2, regexp_extract_all(t, p), regexp_extract_all(t, p), string_split_regex(t, p) FROM (SELECT *, '[0-9a-f]+' AS p FROM d)
  UNION ALL SELECT r, owner, repo, 'owned', 3, regexp_extract_all(t, p), regexp_extract_all(t, p), string_split_regex(t, p) FROM (SELECT *, '[A-Za-z0-9+/_=-]{20,}' AS p FROM d)),
sized AS (SELECT * EXCLUDE (m, g), list_transform(m, lambda x: len(x)) AS lm, list_transform(g, lambda x: len(x)) AS lg FROM cut WHERE len(m) > 0),
numbered AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM sized),
placed AS (
  SELECT r, owner, repo, kind, k, v[i] AS v, (list_sum(lg[1 : i]) + coalesce(list_sum(lm[1 : i - 1]), 0))::BIGINT AS a, lm[i] AS n FROM numbered),
kept AS (
  SELECT r, owner, repo, kind, k, v, a, (a + n)::BIGINT AS b, len(v) >= 16 AND len(list_distinct(string_split(v, ''))) >= 10 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS live
  FROM placed WHERE CASE kind WHEN 'assign' THEN len(v) >= 6 WHEN 'access' THEN n >= 20 WHEN 'hex' THEN n >= 24 ELSE true END),
candidates AS (
  SELECT * FROM kept c WHERE k < 3 OR (live AND NOT EXISTS (SELECT 1 FROM kept o WHERE o.r = c.r AND o.k < 3 AND o.a < c.b AND c.a < o.b))),
owners AS (SELECT v, count(DISTINCT owner) AS n_owners FROM candidates GROUP BY v),
told AS (SELECT c.*, n_owners, live AND n_owners = 1 AS own FROM candidates c JOIN owners USING (v)),
made AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (WHERE k < 3 OR own) AS spans,
         count(*) FILTER (WHERE k = 3 AND own) AS n_owned, count(*) FILTER (WHERE own) AS n_live, count(*) FILTER (WHERE n_owners >= 3) AS n_copied
  FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN made USING (r)
"""


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH told AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
marks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f
  FROM texts LEFT JOIN told USING (doc_id)),
groups AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM marks GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS k, unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, o, unnest(range(1, 6)) AS step FROM orders),
counted AS (
  SELECT part, filter_order, step::INT AS step, o[step] AS k, n, good, toxic, f[o[step]] AS fails,
         len(list_filter(o[1 : step - 1], lambda x: f[x])) > 0 AS gone, len(list_filter(f, lambda x: x)) = 1 AS alone FROM groups, steps),
summed AS (
  SELECT part, filter_order, step, k, (coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0))::BIGINT AS kept, (coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0))::BIGINT AS removed,
         (coalesce(sum(n) FILTER (WHERE fails AND gone), 0))::BIGINT AS redundant, (coalesce(sum(n) FILTER (WHERE fails AND alone), 0))::BIGINT AS unique_fails,
         (coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0))::BIGINT AS good_lost, (coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0))::BIGINT AS toxic_lost
  FROM counted GROUP BY ALL)
SELECT * EXCLUDE (k), (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM summed
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_packing": op1_hierarchical_packing,
    "op2_differencing_shards": op2_differencing_shards,
    "op3_site_spread_lines": op3_site_spread_lines,
    "op4_adaptive_prefix_join": op4_adaptive_prefix_join,
    "op5_simhash_fingerprints": op5_simhash_fingerprints,
    "op5_simhash_links": op5_simhash_links,
    "op6_counterfactual_toxicity": op6_counterfactual_toxicity,
    "op7_pivotal_mixing": op7_pivotal_mixing,
    "op8_fused_language": op8_fused_language,
    "op9_pivot_range_join": op9_pivot_range_join,
    "op10_cotrained_quality": op10_cotrained_quality,
    "op11_bit_sliced_spelling": op11_bit_sliced_spelling,
    "op12_owned_secrets": op12_owned_secrets,
    "op13_filter_interactions": op13_filter_interactions,
}

ORACLE_SQL: dict[str, str] = {"op3_site_spread_lines": OP3_SQL, "op4_adaptive_prefix_join": OP4_SQL, "op9_pivot_range_join": OP9_SQL, "op11_bit_sliced_spelling": OP11_SQL, "op12_owned_secrets": OP12_SQL, "op13_filter_interactions": OP13_SQL}
