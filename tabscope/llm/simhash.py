"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are compared tile by tile with exclusive-or and bit counts in numpy. Two
fingerprints within the radius cannot differ by more than the radius in the number of
set bits, and the same holds for the sum over parts of the fingerprint. So rows are
dealt to tiles by the bit counts of their parts, and only tiles whose counts differ by
at most the radius in sum meet; inside a meeting, sub-tiles sorted by total bit count
skip each other in the same way. Long fingerprints with a wide radius are dealt by the
number of shingles instead, whose ratio bounds the similarity of two sets.

Equal fingerprints are one row before any comparison, so a group of copies costs one.
A tile returns the links that connect its rows, at most one for each row, never all
pairs; ``components`` joins them. Tiles with many rows are split into blocks; a task
holds one block and as many of those it meets as are together no larger than a block.

Near copies are decided by the shingles themselves: the fingerprints, with a radius that
hardly misses a pair, only find groups within which texts may be alike. The shingle sets
of those groups are compared in cells of bounded size, and links below the least
similarity are dropped before the components that count are formed.

Defined cases: a null or empty text has no shingle and the fingerprint zero, which
links like any other; texts shorter than a shingle are one shingle; repeated rows are
copies of each other; a component whose ids are all null has the id null; an empty
table gives no rows; further columns are passed through or left out, never read.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tabscope.llm.common import doc_with_text, map_columns, rows_among, saved, text_column
from tabscope.llm.components import components
from tabscope.session import small_frame

#: Fixed values of the contract.
SEED = 42
#: Rows of a tile that one task compares; larger tiles are split.
TILE_ROWS = 131_072
SUB_TILE = 1_024
PARTS = 4


@dataclass(frozen=True)
class Settings:
    """What is compared, and when two fingerprints link.

    ``repeats``: a shingle counts as often as it comes. ``ratio``: least ratio of the
    numbers of shingles of two linked texts (0: any), by which tiles are dealt then.
    ``least``: least Jaccard similarity of the shingle sets of linked texts (0: any).
    """

    words: int = 3
    bits: int = 64
    radius: int = 2
    repeats: bool = True
    ratio: float = 0.0
    least: float = 0.0


#: Five words and a Jaccard similarity of 0.8 or more: the expected share of differing
#: bits is acos(2 J / (1 + J)) / pi = 0.151 at J = 0.8, so 39 of 256 bits with a standard
#: deviation of 5.7. The radius misses one in 60,000 pairs of 4 and 5 shingles (0.188, the
#: worst case) and under one in 10 million of longer ones; what it lets in besides is
#: dropped by the shingles.
NEAR_COPIES = Settings(words=5, bits=256, radius=75, repeats=False, ratio=0.75, least=0.8)
#: Rows and shingles of a block whose shingle sets are compared in one task.
CLOSE_ROWS, CLOSE_SHINGLES = 2_048, 524_288


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    w = text.lower().split()  # on bytes: A-Z only, and exactly the six separators
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(itertools.islice(w, i, None) for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits for each hash (a finaliser of two multiplications)."""
    if not word:
        return h
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * word) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """Most significant bit first: a bit is set if over half of the hashes set it."""
    out = []
    for word in range(bits // 64):
        votes = np.zeros(64, np.int64)
        for start in range(0, len(hashes), 65_536):
            h = _mixed(hashes[start : start + 65_536], word)
            votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * votes > len(hashes)).tobytes())
    return b"".join(out)


def _class(fp: bytes, n: int, settings: Settings) -> int:
    """The tile class: bit counts of the parts, or the scale of the number of shingles."""
    if settings.ratio:
        return math.floor(math.log(n) / -math.log(settings.ratio)) if n else -1
    size, total = len(fp) // PARTS, 0
    for p in range(PARTS):
        total = total * 1000 + int.from_bytes(fp[p * size : (p + 1) * size], "big").bit_count()
    return total


def fingerprints(docs: DataFrame, carried: list[str], text: str, settings: Settings) -> DataFrame:
    """``carried`` columns, ``fp`` binary, ``n`` (shingles) and ``class`` of every row.

    ``text`` is a column, or else a field of the carried ``_doc``.
    Where shingle sets decide, a digest of the set follows the bits in ``fp``, so rows
    of one ``fp`` have equal sets.
    """
    fields = [docs.schema[c] for c in carried]
    own = [StructField("fp", BinaryType()), StructField("n", LongType()), StructField("class", LongType())]

    def run(batch: pa.RecordBatch, _) -> dict:
        names = batch.schema.names
        fps, ns, classes = [], [], []
        for t in text_column(batch, text).cast(pa.binary()).to_pylist():
            h = shingle_hashes(t or b"", settings.words)
            if not settings.repeats:
                h = np.unique(h)
            fp = fingerprint(h, settings.bits)
            classes.append(_class(fp, len(h), settings))
            fps.append(fp + xxhash.xxh128_digest(h.tobytes()) if settings.least else fp), ns.append(len(h))
        return {c: batch.column(names.index(c)) for c in carried} | {"fp": fps, "n": ns, "class": classes}

    columns = list(dict.fromkeys([*carried, *([text] if text in docs.columns else [])]))
    return map_columns(docs.select(*columns), run, StructType(fields + own), rows=256)


def _near_classes(a: int, present: set[int], settings: Settings) -> list[int]:
    """Classes after ``a`` whose rows may link with rows of ``a``."""
    if settings.ratio:
        return [b for b in (a + 1,) if a >= 0 and b in present]
    parts = [a // 1000**p % 1000 for p in range(PARTS)]
    found = set()
    for moves in itertools.combinations_with_replacement(range(2 * PARTS + 1), settings.radius):
        near = parts.copy()
        for m in moves:
            if m < 2 * PARTS:
                near[m // 2] += 1 if m % 2 else -1
        if min(near) >= 0:
            found.add(sum(x * 1000**p for p, x in enumerate(near)))
    return sorted(b for b in found if b > a and b in present)


def routes(counts: dict[int, int], settings: Settings) -> list[tuple[int, int, int, bool, bool]]:
    """(class, block, cell, home, within): where the rows of a block are compared.

    Every block is at home in cells of its own, and blocks of earlier classes near by and
    earlier blocks of its class visit these: a cell takes visitors of at most TILE_ROWS
    rows in all, or one. In its first cell a block is compared with itself as well.
    """
    blocks = {c: max(1, math.ceil(n / TILE_ROWS)) for c, n in counts.items()}
    visitors: dict[int, list[int]] = {c: [] for c in blocks}
    for a in sorted(blocks):
        for b in _near_classes(a, blocks.keys(), settings):
            visitors[b].append(a)
    out, cell = [], 0
    for b in sorted(blocks):
        far = [(a, i) for a in visitors[b] for i in range(blocks[a])]
        for j in range(blocks[b]):
            out.append((b, j, cell, True, True))
            held = 0.0
            for a, i in [*far, *((b, i) for i in range(j))]:
                rows = counts[a] / blocks[a]
                if held and held + rows > TILE_ROWS:
                    cell, held = cell + 1, 0.0
                    out.append((b, j, cell, True, False))
                out.append((a, i, cell, False, False))
                held += rows
            cell += 1
    return out


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of i[k] and j[k]; a label is the least place in its set."""
    while True:
        a, b = labels[i], labels[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return labels
        i, j = i[apart], j[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while True:
            next_ = labels[labels]
            if (next_ == labels).all():
                break
            labels = next_


def tile_links(
    fps: np.ndarray, n: np.ndarray, home: np.ndarray, settings: Settings, within: bool = True
) -> list[tuple[int, int]]:
    """Links (row, root) that connect the rows of a cell.

    At least one row of a pair is at home; with ``within`` false, exactly one.
    """
    total = np.bitwise_count(fps).sum(axis=1).astype(np.int64)
    order = np.lexsort((total, ~home))  # home rows first, each part by bit count
    fps, n, total, owners = fps[order], n[order], total[order], int(home.sum())
    labels = np.arange(len(fps))
    starts = [*range(0, owners, SUB_TILE), *range(owners, len(fps), SUB_TILE)]
    ends = [min(s + SUB_TILE, owners if s < owners else len(fps)) for s in starts]
    for a, (s, e) in enumerate(zip(starts, ends)):
        if s >= owners:
            break
        for s2, e2 in zip(starts[a:], ends[a:]):
            if s2 < owners and not within:
                continue
            if total[s2] - total[e - 1] > settings.radius or total[s] - total[e2 - 1] > settings.radius:
                continue  # the bit counts differ beyond the radius
            apart = np.zeros((e - s, e2 - s2), np.uint16)
            for word in range(fps.shape[1]):
                apart += np.bitwise_count(fps[s:e, word, None] ^ fps[None, s2:e2, word])
            i, j = np.nonzero(apart <= settings.radius)
            if s == s2:
                i, j = i[i < j], j[i < j]
            i, j = i + s, j + s2
            if settings.ratio and len(i):
                near = np.minimum(n[i], n[j]) >= settings.ratio * np.maximum(n[i], n[j])
                i, j = i[near], j[near]
            if len(i):
                labels = _merge(labels, i, j)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return list(zip(order[linked].tolist(), order[labels[linked]].tolist()))


def links(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links between different fingerprints of ``nodes`` (fp, n, class)."""
    spark = nodes.sparkSession
    counts = {r["class"]: r["count"] for r in nodes.groupBy("class").count().collect()}
    blocks = {c: max(1, math.ceil(k / TILE_ROWS)) for c, k in counts.items()}
    most = max(blocks.values(), default=1)
    table = small_frame(spark, routes(counts, settings), "class long, block long, cell long, home boolean, within boolean")
    # the block is a hash modulo the blocks of the class, which the table knows
    sizes = small_frame(spark, [(c, b) for c, b in blocks.items() if b > 1], "class long, blocks long")
    if most > 1:
        placed = nodes.join(sizes, "class", "left").withColumn(
            "block", F.pmod(F.xxhash64("fp", "n"), F.coalesce("blocks", F.lit(1).cast("long")))
        )
    else:
        placed = nodes.withColumn("block", F.lit(0).cast("long"))
    sent = placed.join(table, ["class", "block"]).select("cell", "home", "within", "fp", "n")

    def run(cell: pa.Table) -> pa.Table:
        values = cell.column("fp").to_pylist()
        matrix = np.frombuffer(b"".join(values), ">u8").reshape(len(values), -1)[:, : settings.bits // 64].astype(np.uint64)
        within = any(cell.column("within").to_pylist())
        found = tile_links(matrix, cell.column("n").to_numpy(), cell.column("home").to_numpy(), settings, within)
        ends = [[values[r[k]] for r in found] for k in (0, 1)]
        return pa.table({"a": pa.array(ends[0], pa.binary()), "b": pa.array(ends[1], pa.binary())})

    return sent.groupBy("cell").applyInArrow(run, "a binary, b binary")


def set_links(sets: list[np.ndarray], groups: list, home: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (row, root) that connect rows of one group with sets of a similarity of at least ``least``.

    Rows at home are compared with each other, or with the other rows if there are any.
    Pairs that are already connected are passed over.
    """
    order = np.array(sorted(range(len(sets)), key=lambda r: (groups[r], not home[r])))
    n = np.array([len(sets[r]) for r in order])
    ids = np.unique(np.concatenate([sets[r] for r in order]), return_inverse=True)[1]
    ends = np.cumsum(n)
    starts = ends - n
    home = home[order]
    flags = np.zeros(len(ids), bool)
    labels = np.arange(len(order))
    edges = [k for k in range(len(order)) if not k or groups[order[k]] != groups[order[k - 1]]] + [len(order)]
    for first, last in itertools.pairwise(edges):
        owners = first + int(home[first:last].sum())
        for r in range(first, owners):
            low = owners if not home.all() else r + 1
            alike = np.minimum(n[r], n[low:last]) >= least * np.maximum(n[r], n[low:last]) - 1e-9
            others = low + np.flatnonzero(alike & (labels[low:last] != labels[r]))
            if not len(others):
                continue
            a, b = others[0], others[-1] + 1
            own = ids[starts[r] : ends[r]]
            flags[own] = True
            common = np.add.reduceat(flags[ids[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], dtype=np.int64)[others - a]
            flags[own] = False
            near = others[common >= least * (n[r] + n[others] - common) - 1e-9]
            if len(near):
                labels = _merge(labels, np.full(len(near), r), near)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return list(zip(order[linked].tolist(), order[labels[linked]].tolist()))


def dealt(members: DataFrame) -> DataFrame:
    """(node, root, _row, cell, i, j, home): the cells in which the rows of ``members`` meet.

    Small groups share cells, on average of a block's size; the rows of a large group are
    dealt to blocks, and each pair of its blocks is a cell.
    """
    blocks = F.ceil(F.greatest(F.count("*") / CLOSE_ROWS, F.sum("n") / CLOSE_SHINGLES))
    sizes = members.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), blocks.alias("blocks"))
    total = sizes.where("blocks = 1").agg(F.sum("rows"), F.sum("shingles")).first()
    buckets = max(1, math.ceil(max((total[0] or 0) / CLOSE_ROWS, (total[1] or 0) / CLOSE_SHINGLES)))
    # at most one group for each CLOSE_ROWS rows or CLOSE_SHINGLES shingles
    large = F.broadcast(sizes.where("blocks > 1").select("root", "blocks"))
    return (
        members.join(large, "root", "left")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        .select(
            "node",
            "root",
            "_row",
            F.when(F.col("blocks").isNull(), F.lit(b"")).otherwise(F.col("root")).alias("cell"),
            # least passes over nulls, so the null block of a small group needs a case of its own
            F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.least("block", "other")).alias("i"),
            F.greatest(F.lit(-1).cast("long"), F.when(F.col("blocks").isNotNull(), F.greatest("block", "other"))).alias("j"),
            (F.col("blocks").isNull() | (F.col("block") <= F.col("other"))).alias("home"),
        )
    )


def similar(found: DataFrame, nodes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links of similar shingle sets within the groups (node, root) of ``found``.

    ``texts`` has (_row, _text); only those of the groups leave their tasks, as shingle
    sets, which meet in the cells of ``dealt``.
    """
    members = saved(
        found.join(nodes.hint("merge"), found.node == nodes.fp).select("node", "root", F.col("first._row").alias("_row"), "n"),
        "members",
    )
    placed = dealt(members)

    def sets(batch: pa.RecordBatch, _) -> dict:
        found = [np.unique(shingle_hashes(t or b"", settings.words)).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return {"_row": batch.column(0), "shingles": found}

    wanted = rows_among(texts, members.select("_row")).select("_row", "_text")
    hashed = map_columns(wanted, sets, "_row long, shingles binary", rows=256)
    sent = placed.join(hashed.hint("merge"), "_row").select("cell", "i", "j", "home", "node", "root", "shingles")

    def run(cell: pa.Table) -> pa.Table:
        nodes = cell.column("node").to_pylist()
        found = set_links(
            [np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()],
            cell.column("root").to_pylist(), cell.column("home").to_numpy(), settings.least,
        )
        ends = [[nodes[r[k]] for r in found] for k in (0, 1)]
        return pa.table({"a": pa.array(ends[0], pa.binary()), "b": pa.array(ends[1], pa.binary())})

    return sent.groupBy("cell", "i", "j").applyInArrow(run, "a binary, b binary")


def labelled(rows: DataFrame, order: list[str], settings: Settings, texts: DataFrame | None = None) -> DataFrame:
    """(fp, first): for each fingerprint the least ``order`` of its component, nulls last.

    ``rows`` is a written table with fp, n, class and the columns of ``order``; ``texts``
    (_row, _text) is read where shingle sets decide.
    """
    first = F.struct(*[F.coalesce(F.col(c), F.lit(2**63 - 1)).alias(c) for c in order])
    nodes = saved(
        rows.groupBy("fp").agg(F.min("n").alias("n"), F.min("class").alias("class"), F.min(first).alias("first")),
        "fingerprints",
    )
    found = saved(components(links(nodes, settings)), "components")
    if settings.least:
        found = saved(components(similar(found, nodes, texts, settings)), "components")
    least = (
        found.join(nodes, found.node == nodes.fp).groupBy("root").agg(F.min("first").alias("least"))
    )
    linked = found.join(least, "root").select(F.col("node").alias("fp"), "least")
    return saved(
        nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")), "labels"
    )


def simhash_components(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; fingerprint in lower-case hex."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = saved(fingerprints(narrow, ["doc_id"], "text", settings), "simhash")
    labels = labelled(rows, ["doc_id"], settings)
    return rows.select("doc_id", "fp").join(labels, "fp").select(
        "doc_id",
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.nullif(F.col("first.doc_id"), F.lit(2**63 - 1)).alias("component_id"),
    )


def keep_first(docs: DataFrame, settings: Settings = NEAR_COPIES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``: the least id, then the first such row.

    Fingerprints are written next to the rows and read alone for the comparison; rows
    are picked where they lie, by row number, which no group of copies can make hot.
    """
    columns, body = doc_with_text(docs, text)
    wide = docs.select(
        *columns,
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = saved(fingerprints(wide, ["_doc", "_id", "_row"], body, settings), "simhash")
    texts = rows.select("_row", F.col("_doc").getField(text).cast("string").alias("_text"))
    first = labelled(rows, ["_id", "_row"], settings, texts).select(F.col("first._row").alias("_row")).distinct()
    return rows_among(rows, first).select("_doc.*")
