"""Secrets in texts, told apart by who owns them: values copied widely are examples, those of one owner look live."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checked_broadcast, discard, join_few, materialize, small_batches, tidy
from predio.llm.textkernel import spans, text_arrays

#: Kinds of spans in their order; the last is added by ownership.
KINDS = ("assign", "access", "hex", "owned")
_ASSIGN, _ACCESS, _HEX, _BARE = range(4)

_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGNED = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{16,}")
LEAST_VALUE, LEAST_HEX, LEAST_BARE = 6, 24, 20
#: A value looks live if it is so long, holds a letter and a digit, and so many different characters.
LIVE_LENGTH, LIVE_CHARACTERS = 16, 10


def _bytes_of(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(characters, np.uint8)] = True
    return table


_HEX_BYTES = _bytes_of(b"0123456789abcdef")
_BARE_BYTES = _bytes_of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def looks_live(value: str) -> bool:
    return len(value) >= LIVE_LENGTH and len(set(value)) >= LIVE_CHARACTERS and bool(re.search("[0-9]", value)) and bool(re.search("[A-Za-z]", value))


def _runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int, kind: int) -> list[tuple[int, int, int, int]]:
    """(text, kind, first byte, end byte) of the runs of at least ``least`` bytes in ``inside``."""
    starts, ends, _ = spans(data, offsets, inside)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    text = np.searchsorted(offsets, starts, side="right") - 1
    return list(zip(text.tolist(), [kind] * len(text), (starts - offsets[text]).tolist(), (ends - offsets[text]).tolist(), strict=True))


def find_spans(texts: pa.Array) -> Iterator[list[tuple[int, int, int, str]]]:
    """Per text its (kind, start, end, value), by start and kind, in code points: all base spans, and bare values that look live and touch none of these.

    Where a run must be long to count, only long runs are searched for: a
    short one takes in no part of another.
    """
    for first, data, offsets in text_arrays(texts):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for inside, least, kind in ((_HEX_BYTES, LEAST_HEX, _HEX), (_BARE_BYTES, LEAST_BARE, _BARE)):
            for text, *run in _runs(data, offsets, inside, least, kind):
                runs.setdefault(text, []).append(tuple(run))
        for i in range(len(offsets) - 1):
            text = texts[first + i].as_py() or ""
            low = text.lower()
            found = []
            if any(word in low for word in _KEYWORDS):
                found += [(_ASSIGN, m.start(), m.end(), m[2]) for m in _ASSIGNED.finditer(text) if len(m[2]) >= LEAST_VALUE]
            if "AKIA" in text:
                found += [(_ACCESS, m.start(), m.end(), m[0]) for m in _ACCESS_KEY.finditer(text)]
            bare = []
            if i in runs:
                raw = data[offsets[i] : offsets[i + 1]]
                place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
                for kind, a, b in runs[i]:
                    start = int(place[a])
                    (found if kind == _HEX else bare).append((kind, start, start + b - a, raw[a:b].tobytes().decode()))
            found.sort(key=lambda s: (s[1], s[0]))
            if bare:
                bare = [s for s in bare if looks_live(s[3])]
                taken = np.zeros(len(text) + 1, np.int64)  # how many base spans begin or end at each place
                for _, start, end, _ in found:
                    taken[start] += 1
                    taken[end] -= 1
                free = np.concatenate([[0], np.cumsum(np.cumsum(taken) > 0)]) if bare else taken
                found = sorted([*found, *(s for s in bare if free[s[1]] == free[s[2]])], key=lambda s: (s[1], s[0]))
            yield found


def spelled(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end, _ in found)


_SPAN = "array<struct<kind tinyint, start long, end long, value binary, live boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("live", pa.bool_())]))
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        counts, base, sha, found = [[], [], []], [], [], []
        for spanned in find_spans(texts):
            kept = [s for s in spanned if s[0] != _BARE]
            for kind, column in enumerate(counts):
                column.append(sum(s[0] == kind for s in kept))
            base.append(spelled(kept))
            sha.append(hashlib.sha256(base[-1].encode()).hexdigest())
            found.append([{"kind": k, "start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "live": looks_live(v)} for k, a, b, v in spanned])
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "owner", "repository")]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(base, pa.string()), pa.array(found, span)], names=["id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])


def owned_values(candidates: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, n_spans) of every candidate value; ``candidates`` has value, owner, repository.

    Spans of a value in one repository are combined before the shuffle, and
    so are its repositories and owners, so a value in a third of all texts is
    counted by all tasks.
    """
    placed = candidates.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    owners = placed.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_spans"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, example_owners: int = 3) -> DataFrame:
    """Per row: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied.

    One pass finds the base spans and, besides, bare values that look live.
    Each candidate's hash is then counted over the whole corpus by distinct
    owners and distinct repositories (a repository belongs to its owner).
    A value with ``example_owners`` owners or more is a widely copied example;
    one of a single owner that looks live is that owner's own.  Bare values
    of the latter sort are added to the base spans as ``owned``.
    ``n_live`` counts a text's spans with an owner's own value, ``n_copied``
    those with an example.  Only hashes are moved, never texts or secrets.

    Without ``owner`` and ``repository`` the column source and the id are
    taken.  A null text is empty, a null owner or repository is one of its
    own kind; repeated rows give a result each; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    named = lambda c: F.coalesce(c.cast("string"), F.lit("\u0000"))
    owner = named(F.col("source") if owner is None else owner)
    repository = named(F.col(id_col) if repository is None else repository)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), owner.alias("owner"), repository.alias("repository"))
    id_type = given.schema["id"].dataType.simpleString()
    scanned = given.mapInArrow(tidy(_scan), f"id {id_type}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, base string, found {_SPAN}")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "secret-spans")

    candidates = scanned.where(F.size("found") > 0).select("row", "owner", "repository", F.inline("found"))
    values = materialize(owned_values(candidates.select("value", "owner", "repository")), "secret-values")
    classes = values.select("value", (F.col("n_owners") >= example_owners).alias("example"), (F.col("n_owners") == 1).alias("single"))
    told = candidates.join(checked_broadcast(classes, row_bytes=F.lit(96)), "value")
    own = F.col("single") & F.col("live")
    added = F.array_sort(F.collect_list(F.when(own & (F.col("kind") == _BARE), F.struct("start", "kind", "end"))))
    rows = told.groupBy("row").agg(added.alias("added"), F.count_if(own).alias("n_live"), F.count_if("example").alias("n_copied"))
    rows = materialize(rows, "secret-rows")
    out = join_few(scanned, rows, "row", "left", row_bytes=64 + 24 * F.size("added"))
    base = F.transform(F.filter("found", lambda s: s["kind"] != _BARE), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    kind = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(F.array_sort(F.concat(base, "added")), lambda s: F.concat_ws(":", F.element_at(kind, s["kind"].cast("int") + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n_added = F.coalesce(F.size("added"), F.lit(0))
    discard(values)
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.when(n_added > 0, text).otherwise(F.col("base")).alias("spans"),
        n_added.cast("long").alias("n_owned"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
