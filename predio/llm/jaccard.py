"""Exact n-gram Jaccard links with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import Members, checked_broadcast, discard, found_in, materialize, small_batches, tidy
from predio.llm.components import connected_components
from predio.llm.textkernel import mix, shingle_sets

#: Shingles counted together in a task before those that recur are handed on.
COUNTED_AT_ONCE = 2_000_000
#: Bits of a frequency slot, and of its page and its place there.
SLOT_BITS, PAGE_BITS = 24, 8
_PLACES = 1 << (SLOT_BITS - PAGE_BITS)
#: Bits of the small parity map that bounds how much two sets differ, and the most bits of the large one, which has one for each shingle.
MAP_BITS, MOST_PARITY_BITS = 512, 1 << 17
#: Partial counts of a page that one group adds up at most, about.
PAGE_ROWS = 256
#: Documents of one side of a block of a shingle that very many prefixes share.
BLOCK_ROWS = 2048
#: Partners of a document that meet one copy of its map or set.
PARTNER_ROWS = 512
#: Frequencies are kept as a byte: steps of a twelfth of a power of two.
_STEP = 12.0


def _signatures(width: int):
    """Per document its set size and two sums that tell sets apart; besides, counts of shingles that recur."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("parity", pa.list_(pa.int64())), ("map", pa.list_(pa.int64())), ("page", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])

    def recurring(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = counts > 1
        slots, counts = (tokens[often] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), counts[often].astype("<u4")
        edges = np.searchsorted(slots, np.arange((1 << PAGE_BITS) + 1) * _PLACES)
        pages = [p for p in range(1 << PAGE_BITS) if edges[p] < edges[p + 1]]
        none = pa.nulls(len(pages), pa.int64())
        places = [(slots[edges[p] : edges[p + 1]] % _PLACES).astype("<u2").tobytes() for p in pages]
        yield pa.RecordBatch.from_arrays([none, none, none, none, *[pa.nulls(len(pages), pa.list_(pa.int64()))] * 2, pa.array(pages, pa.int32()), pa.array(places, pa.binary()), pa.array([counts[edges[p] : edges[p + 1]].tobytes() for p in pages], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0
        for batch in batches:
            sizes, first, second, parity, small = [], [], [], [], []
            for tokens in shingle_sets(batch.column(1), width):
                sizes.append(len(tokens))
                first.append(tokens.sum(dtype=np.uint64))
                second.append(mix(tokens).sum(dtype=np.uint64))
                parity.append(_parity(tokens, min(max(MAP_BITS, 1 << (len(tokens) - 1).bit_length()), MOST_PARITY_BITS)))
                small.append(_parity(tokens, MAP_BITS))
                waiting.append(tokens)
                held += len(tokens)
                if held >= COUNTED_AT_ONCE:
                    yield from recurring(waiting)
                    waiting, held = [], 0
            empty = [pa.nulls(len(sizes), t) for t in (pa.int32(), pa.binary(), pa.binary())]
            sums = [pa.array(np.array(s, np.uint64).view(np.int64)) for s in (first, second)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *sums, *[pa.array(p, pa.list_(pa.int64())) for p in (parity, small)], *empty], schema=schema)
        if held:
            yield from recurring(waiting)

    return run


def _parity(tokens: np.ndarray, bits: int) -> list[int]:
    """Whether an odd number of shingles fall on each of so many places: sets differ in at least as many shingles as their maps in bits."""
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _differ(a: str, b: str) -> Column:
    """Bits in which two parity maps differ; the larger is folded to the size of the other."""

    def folded(one: str, other: str) -> Column:
        half = (F.size(one) / 2).cast("int")
        return F.when(F.size(one) > F.size(other), F.zip_with(F.slice(one, F.lit(1), half), F.slice(one, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(one))

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, v: n + v)


def _page_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    places = np.concatenate([np.frombuffer(b, "<u2") for b in pdf["places"]])
    counts = np.concatenate([np.frombuffer(b, "<u4") for b in pdf["counts"]])
    total = np.bincount(places, counts, minlength=_PLACES).astype(np.int64)  # exact: counts stay far below 2**53
    used = np.flatnonzero(total)
    return pd.DataFrame({"page": [pdf["page"].iloc[0]], "places": [used.astype("<u2").tobytes()], "counts": [np.minimum(total[used], 2**32 - 1).astype("<u4").tobytes()]})


def _frequencies(partial: DataFrame) -> np.ndarray:
    """A byte per slot, in a table of fixed size: how often the shingles of that slot recur in the corpus."""
    schema = "page int, places binary, counts binary"
    salts = max(1, partial.count() // (PAGE_ROWS << PAGE_BITS))
    if salts > 1:
        partial = partial.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(salts))).groupBy("page", "salt").applyInPandas(_page_sums, schema)
    table = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    for row in partial.groupBy("page").applyInPandas(_page_sums, schema).toLocalIterator():
        levels = np.minimum(255, _STEP * np.log2(1.0 + np.frombuffer(row["counts"], "<u4")))
        table[row["page"] * _PLACES + np.frombuffer(row["places"], "<u2").astype(np.int64)] = levels.astype(np.uint8)
    return table


def choose_extra(frequency: np.ndarray, n: int, base: int, most: int) -> int:
    """How many matches a document asks for: the length of prefix whose estimated cost is least.

    ``frequency`` holds the estimated document frequencies of its rarest
    shingles in order.  Scanning costs the postings of the prefix; each
    candidate that then has enough matches costs a comparison of whole sets.
    """
    postings = np.cumsum(frequency)
    wanted = np.arange(1, most + 1)
    at = base + wanted - 2
    scan = postings[at]
    candidates = np.maximum(scan - (at + 1), 0) / wanted
    return int(np.argmin(scan + 2.0 * n * candidates)) + 1


def _prefixes(width: int, percent: int, most_matches: int, table):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("matches", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = table.value
        count_of = np.exp2(np.arange(256) / _STEP)
        for batch in batches:
            ids, sizes, matches, prefixes, lengths = [], [], [], [], [0]
            for doc_id, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
                n = len(tokens)
                if not n or doc_id is None:
                    continue
                need = -(-percent * n // 100)
                base, most = n - need + 1, min(most_matches, need)
                levels = level[(tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                order = np.argsort((levels.astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8)), kind="stable")[: base + most - 1]
                extra = choose_extra(count_of[levels[order]], n, base, most)
                ids.append(doc_id), sizes.append(n), matches.append(extra)
                prefixes.append(tokens[order[: base + extra - 1]].view(np.int64))
                lengths.append(lengths[-1] + len(prefixes[-1]))
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(matches, pa.int64()), lists], schema=schema)

    return run


def _sets(width: int, members):
    """Shingle sets of the documents in a membership table, and of few others."""
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(found_in(members.value, batch.column(2).to_numpy())))
            sets = [t.view(np.int64) for t in shingle_sets(batch.column(1), width)]
            lengths = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=schema)

    return run


def _hot(pairs: DataFrame, end: str) -> DataFrame:
    """(id, parts) of the documents at ``end`` with very many partners."""
    counts = pairs.groupBy(F.col(end).alias("id")).agg(F.ceil(F.count("*") / PARTNER_ROWS).cast("int").alias("parts"))
    return checked_broadcast(materialize(counts.where("parts > 1"), "jaccard-hot"))


def _joined_at(end: str, pairs: DataFrame, values: DataFrame, hot: DataFrame, **columns: str) -> DataFrame:
    """``pairs`` with columns of ``values`` (by id) for the document at ``end``; a hot one is copied, and its partners are dealt out to its copies."""
    other = "y" if end == "x" else "x"
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("parts"))).cast("int").alias("part")
    dealt = pairs.join(hot.withColumnRenamed("id", end), end, "left").select(*pairs.columns, part)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    values = values.join(hot, "id", "left").select(F.col("id").alias(end), *[F.col(c).alias(name) for name, c in columns.items()], copies)
    return dealt.join(values, [end, "part"]).drop("part")


def _verified(texts: DataFrame, heads: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (x, y) whose whole sets are similar enough.

    Parity maps drop pairs that differ too much without reading the texts;
    the rest are compared on their sets.  Texts are read where they lie: a
    membership table picks those whose sets are made, and only sets move.
    """
    members = lambda p: materialize(p.select(F.col("x").alias("id")).unionByName(p.select(F.col("y").alias("id"))).distinct(), "jaccard-ids")
    ids = members(pairs)
    maps = heads.join(checked_broadcast(ids), "id", "left_semi").select("id", "n", "parity")
    hot_x, hot_y = _hot(pairs, "x"), _hot(pairs, "y")
    near = _joined_at("y", _joined_at("x", pairs, maps, hot_x, nx="n", px="parity"), maps, hot_y, ny="n", py="parity")
    differ = F.when(F.greatest(F.size("px"), F.size("py")) <= 2 * F.least(F.size("px"), F.size("py")), _differ("px", "py")).otherwise(0)
    # common = (nx + ny - difference) / 2 must reach percent / (100 + percent) of nx + ny
    near = materialize(near.where((100 + percent) * (F.col("nx") + F.col("ny") - differ) >= 2 * percent * (F.col("nx") + F.col("ny"))).select("x", "y").distinct(), "jaccard-near")
    wanted = members(near)
    table = Members(wanted)
    sets = texts.where(F.col("id").isNotNull()).select("id", "text", table.slot(F.col("id")).alias("slot")).mapInArrow(tidy(_sets(width, table.table)), "id long, tokens array<long>")
    sets = materialize(sets, "jaccard-sets")
    table.table.destroy()
    both = _joined_at("y", _joined_at("x", near, sets, hot_x, tx="tokens"), sets, hot_y, ty="tokens").withColumn("common", F.size(F.array_intersect("tx", "ty")))
    union = F.size("tx") + F.size("ty") - F.col("common")
    links = materialize(both.where(100 * F.col("common") >= percent * union).select("x", "y").distinct(), "jaccard-links")
    discard(ids, near, wanted, sets)
    return links


def _can_match(nx: Column, ny: Column, percent: int) -> Column:
    return (100 * F.least(nx, ny)) >= (percent * F.greatest(nx, ny))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, most_matches: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row, where links are word-shingle sets with Jaccard of ``percent`` or more.

    1. Rows with equal sets form a class, told apart by size and two 64-bit
       sums; only a class's smallest id takes part in the join.
    2. A table of fixed size estimates how often each shingle recurs.  Rare
       shingles come first in the common order; any order gives right results.
    3. Each document takes the prefix length, and with it the number of shared
       prefix shingles it asks of a partner, that cost least by these
       estimates.  Two documents need the smaller of their two numbers.
    4. First the document in which a prefix shingle comes earliest is compared
       with the others, which joins large groups of near copies with few pairs.  Then
       every other pair that shares enough prefix shingles is compared, unless
       already in one component: no link between components is lost.
    5. Pairs are verified on whole sets; before that, maps of a bit for each
       shingle prove most other pairs too different.

    Texts without words and null texts have no shingles and no links.  Rows
    that repeat an id are one node.  A null id takes no part and has a null
    component.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = materialize(texts.mapInArrow(tidy(_signatures(width)), "doc_id long, n long, s1 long, s2 long, parity array<long>, map array<long>, page int, places binary, counts binary"), "jaccard-rows")
    rows = first.where("page is null").select("doc_id", "n", "s1", "s2")
    classes = materialize(rows.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id")), "jaccard-classes")
    table = spark.sparkContext.broadcast(_frequencies(first.where("page is not null").select("page", "places", "counts")))
    heads = first.where("page is null and n > 0").select(F.col("doc_id").alias("id"), "n", "parity", "map")
    own = materialize(classes.select("id").distinct(), "jaccard-heads")
    few = checked_broadcast(own)
    schema = "id long, n long, matches long, prefix array<long>"
    make = tidy(_prefixes(width, percent, most_matches, table))
    # without a broadcast the prefixes move to the ids, not the texts
    prefixes = texts.mapInArrow(make, schema).join(own, "id", "left_semi") if few is own else texts.join(few, "id", "left_semi").mapInArrow(make, schema)
    prefixes = materialize(prefixes, "jaccard-prefixes")
    table.destroy()
    discard(own)
    # size, matches and place share one number: the entries are the bulk of what is shuffled
    packed = F.shiftleft("n", 32).bitwiseOR(F.shiftleft("matches", 28)).bitwiseOR(F.col("pos"))
    entries = prefixes.select("id", "n", "matches", F.posexplode("prefix").alias("pos", "token")).select("token", "id", packed.alias("packed"))

    # the document in which a shingle comes earliest has few rarer ones of its own: of near copies, it is nearest to their origin
    earliest = F.col("packed").bitwiseAND((1 << 28) - 1) * (1 << 16) + F.xxhash64("id").bitwiseAND((1 << 16) - 1)
    leaders = entries.groupBy("token").agg(F.min_by("id", earliest).alias("lead"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    shared = entries.join(leaders, "token").withColumn("n", F.shiftright("packed", 32)).withColumn("matches", F.shiftright("packed", 28).bitwiseAND(15)).withColumn("pos", F.col("packed").bitwiseAND((1 << 28) - 1))
    shared = materialize(shared.drop("packed"), "jaccard-shared")
    met = materialize(shared.where("id != lead").groupBy(F.col("lead").alias("x"), F.col("id").alias("y")).agg(F.count("*").alias("hits"), F.first("n").alias("ny"), F.first("matches").alias("my")), "jaccard-met")
    stars = _joined_at("x", met, prefixes, _hot(met, "x"), nx="n", mx="matches").where(_can_match(F.col("nx"), F.col("ny"), percent) & (F.col("hits") >= F.least("mx", "my")))
    stars = materialize(stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "jaccard-stars")
    discard(met)
    links = _verified(texts, heads, stars, width, percent)

    joined = connected_components(links, "x", "y")
    at = shared.drop("lead").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = at.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("rows")).where("a != b").select("token", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("parts"))
    maps = heads.select("id", "map")
    opened = materialize(at.join(materialize(mixed, "jaccard-mixed"), "token").join(maps, "id"), "jaccard-open")
    discard(prefixes, shared)
    # the documents of a shingle that very many share meet in blocks, each pair of their chunks in one
    at = opened.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("q", F.least("chunk", "other")).withColumn("d", F.greatest("chunk", "other"))
    x, y = at.alias("x"), at.alias("y")
    nx, ny, px, py = F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")
    most = F.least(px, py) + F.least(nx - px, ny - py)
    differ = sum((F.bit_count(F.get("x.map", F.lit(i)).bitwiseXOR(F.get("y.map", F.lit(i)))) for i in range(8)), F.lit(0))
    pairs = x.join(
        y, (F.col("x.token") == F.col("y.token")) & (F.col("x.q") == F.col("y.q")) & (F.col("x.d") == F.col("y.d")) & ((F.col("x.chunk") != F.col("y.chunk")) | (F.col("x.q") == F.col("x.d")))
        & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & _can_match(nx, ny, percent) & ((100 + percent) * most >= percent * (nx + ny))
        & ((100 + percent) * (nx + ny - differ) >= 2 * percent * (nx + ny))
    )
    pairs = pairs.groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y")).agg(F.count("*").alias("hits"), F.min(F.least("x.matches", "y.matches")).alias("asked")).where("hits >= asked").select("x", "y")
    pairs = materialize(pairs.join(stars, ["x", "y"], "left_anti"), "jaccard-pairs")
    discard(opened)
    links = links.unionByName(_verified(texts, heads, pairs, width, percent))

    joined = materialize(connected_components(links, "x", "y"), "jaccard-components")
    discard(stars, pairs)
    classes = classes.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return rows.join(classes.drop("id"), ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
