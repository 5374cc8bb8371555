"""BPE encoding by a table of distinct words, and decoding through a table of pieces.

Spark splits texts into words, the longest pieces that a byte-level BPE surely keeps
apart: a word ends where a space or line break follows a character that is neither white
space nor a control. Words are counted; those that come more than once are encoded once
each, by the public tokenizer itself, and make the table (word, n, ids). Texts are then
encoded by joining ids back to the words by position. A word that comes once in the whole
corpus has one position only and is encoded there.

The join has two parts. The most frequent words, as many as fit in a documented number
of bytes, are broadcast in a compact form and joined inside the map over the texts. If
that is not the whole table, occurrences of all other words leave holes, which an
ordinary join by word fills; the holes of a text go back to it by its row number. A word
that is not broadcast has at most total / BYTES of the occurrences, so a key of that join
holds at most the word's length / BYTES of the text.

Decoding joins ids with the table of pieces by id. That table has the size of the
vocabulary; pieces are gathered by position and the bytes of a text read as UTF-8, with
the replacement character where they are none.

Defined cases: a null text is an empty one and has no ids; special tokens written in a
text are encoded as such, as the tokenizer does by default; white space alone is a word;
a text without white space is one word, whatever its length; repeated rows and null ids
are rows of their own; an empty table gives no rows; further columns come back in
``_doc``, whatever their names.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from tabscope.llm.common import map_columns, saved, text_of

#: Bytes of the words and ids that are broadcast at most, and of one entry besides them.
BYTES, ENTRY_BYTES = 128_000_000, 24
#: Steps of frequency for each doubling; words of one step are broadcast together or not at all.
STEPS = 8
#: No token of a byte-level BPE goes on where a space or line break follows such a character.
WORD_END = r"(?<=[^\p{Z}\p{C}])(?=[ \n])"
#: Words whose ids are gathered at once, and ids that are decoded at once.
GATHERED, DECODED = 500_000, 1_000_000


def split_words(text: Column) -> Column:
    """The words of a text; together they are the text."""
    return F.split(text, WORD_END)


_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """One tokenizer for each worker process, without truncation and padding."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _TOKENIZERS[path] = loaded
    return _TOKENIZERS[path]


def encode_all(path: str, words: list[str]) -> list[bytes]:
    """The ids of each word as little-endian uint32 numbers."""
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer(path).encode_batch(words, add_special_tokens=False)]


def word_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n, ids): every distinct word that comes more than once, its occurrences and its ids."""
    words = docs.select(F.explode(split_words(text_of(f"`{text}`"))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > 1)

    def run(batch, _) -> dict:
        return {"word": batch.column(0), "n": batch.column(1), "ids": encode_all(path, batch.column(0).to_pylist())}

    return map_columns(counted, run, "word string, n long, ids binary", rows=4096)


def _step() -> Column:
    return F.floor(F.log2("n") * STEPS).cast("int")


def least_step(words: DataFrame, limit: int = BYTES) -> int | None:
    """The least frequency step from which on all words fit in ``limit`` bytes; None if that is every word."""
    size = F.octet_length("word") + F.octet_length("ids") + ENTRY_BYTES
    left = limit
    # 64 doublings at most, so a few hundred rows
    steps = sorted(words.groupBy(_step().alias("step")).agg(F.sum(size).alias("bytes")).collect(), reverse=True)
    for i, row in enumerate(steps):
        left -= row["bytes"]
        if left < 0:
            return steps[i - 1]["step"] if i else 1 + row["step"]
    return None


def packed(table: pa.Table) -> bytes:
    """(word, ids) as an Arrow stream of words in the order of their hashes."""
    table = table.combine_chunks()
    hashes = np.array([xxh64_intdigest(w) for w in table.column("word").to_pylist()], np.uint64)
    order = pa.array(np.argsort(hashes, kind="stable"))
    words, ids = (table.column(c).combine_chunks().take(order) for c in ("word", "ids"))
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    numbers = np.frombuffer(ids.buffers()[2] or b"", "<u4")[: offsets[-1] // 4]
    small = numbers.astype(np.uint16) if numbers.max(initial=0) < 2**16 else numbers
    lists = pa.ListArray.from_arrays(pa.array(offsets // 4, pa.int32()), pa.array(small))
    columns = pa.table({"hash": hashes[order.to_numpy()], "word": words, "ids": lists})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, columns.schema) as writer:
        writer.write_table(columns)
    return sink.getvalue().to_pybytes()


class Known:
    """Broadcast words, found by hash and compared in full."""

    def __init__(self, stream: bytes):
        with pa.ipc.open_stream(stream) as reader:
            table = reader.read_all().combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
        self.hashes, self.words = columns[0].to_numpy(), columns[1]
        self.ids = columns[2].values.to_numpy()
        offsets = columns[2].offsets.to_numpy().astype(np.int64) if len(self.hashes) else np.zeros(1, np.int64)
        self.starts, self.sizes = offsets[:-1], np.diff(offsets)
        # of words with one hash a search finds the first; the others are looked up by name
        equal = np.flatnonzero(self.hashes[1:] == self.hashes[:-1]) + 1
        self.others = {self.words[int(i)].as_py(): int(i) for i in equal}

    def place(self, words: pa.StringArray) -> np.ndarray:
        """The row of each word, -1 where it is not here."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        names = words.to_pylist()
        hashes = np.array([xxh64_intdigest(w) for w in names], np.uint64)
        rows = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = pc.equal(self.words.take(pa.array(rows)), words).to_numpy(zero_copy_only=False)
        rows = np.where(same, rows, -1)
        if self.others:
            for i in np.flatnonzero(rows < 0):
                rows[i] = self.others.get(names[i], -1)
        return rows


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start : start + size]`` of all places, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]


def encode_words(words: pa.ListArray, known: Known, path: str, complete: bool) -> tuple[list[bytes], list[list[dict]]]:
    """(ids of each text, [{at: ids before it, word}] of the words that are left out).

    With a ``complete`` table words that it lacks come once in the corpus, so they are
    encoded here; else they are left out.
    """
    edges = words.offsets.to_numpy()
    flat = words.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
    edges = edges - edges[0]
    distinct, codes = flat.dictionary, flat.indices.to_numpy()
    rows = known.place(distinct)
    here, lacking = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
    # the ids of the distinct words, then their places
    ids = gather(known.ids, known.starts[rows[here]], known.sizes[rows[here]]).astype(np.uint32)
    sizes = np.zeros(len(distinct), np.int64)
    sizes[here] = known.sizes[rows[here]]
    names = distinct.take(pa.array(lacking)).to_pylist()
    if complete:
        own = encode_all(path, names)
        sizes[lacking] = [len(x) // 4 for x in own]
        ids = np.concatenate([ids, np.frombuffer(b"".join(own), "<u4")])
    starts = np.zeros(len(distinct), np.int64)
    order = np.concatenate([here, lacking])
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    pieces = []
    for a in range(0, len(codes), GATHERED):
        c = codes[a : a + GATHERED]
        pieces.append(gather(ids, starts[c], sizes[c]).astype("<u4").tobytes())
    ends = 4 * np.concatenate([[0], np.cumsum(sizes[codes])])
    joined = b"".join(pieces)
    texts = [joined[a:b] for a, b in zip(ends[edges[:-1]], ends[edges[1:]])]
    holes: list[list[dict]] = [[] for _ in texts]
    if not complete:
        missing = np.full(len(distinct), -1)
        missing[lacking] = np.arange(len(lacking))
        places = np.flatnonzero(missing[codes] >= 0)
        for place, text in zip(places, np.searchsorted(edges, places, side="right") - 1):
            holes[text].append({"at": int(ends[place] - ends[edges[text]]) // 4, "word": names[missing[codes[place]]]})
    return texts, holes


_KNOWN: list = [None, None]


def known_words(shared) -> Known:
    """One table for each worker process; it stays while tasks use the same broadcast."""
    if _KNOWN[0] is not shared.value:
        _KNOWN[:] = [shared.value, Known(shared.value)]
    return _KNOWN[1]


def encode(docs: DataFrame, path: str, text: str = "text", limit: int = BYTES) -> DataFrame:
    """(``_doc``, ids): the ids of every text as little-endian uint32 numbers.

    ``_doc`` holds the columns of ``docs`` but the text; ``path`` is the tokenizer's file.
    """
    spark = docs.sparkSession
    words = saved(word_table(docs, path, text), "words")
    least = least_step(words, limit)
    frequent = words if least is None else words.where(_step() >= least)
    table = frequent.select("word", "ids").toArrow()  # bounded by ``limit``
    shared = spark.sparkContext.broadcast(packed(table))
    complete = least is None

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_doc")
    wide = docs.select(own, split_words(text_of(f"`{text}`")).alias("words"))
    hole = StructType([StructField("at", LongType()), StructField("word", StringType())])
    schema = StructType([wide.schema["_doc"], StructField("ids", BinaryType()), StructField("holes", ArrayType(hole))])

    def run(batch, state) -> dict:
        ids, holes = encode_words(batch.column(1), state, path, complete)
        return {"_doc": batch.column(0), "ids": ids, "holes": holes}

    coded = map_columns(wide, run, schema, lambda: known_words(shared), rows=512)
    return coded.drop("holes") if complete else _filled(coded, words.where(_step() < least), path)


def _filled(coded: DataFrame, rare: DataFrame, path: str) -> DataFrame:
    """``coded`` with the ids of ``rare`` words in the holes; what is not among them comes once."""
    coded = saved(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    holes = coded.select("row", F.posexplode("holes").alias("nth", "hole")).select("row", "nth", "hole.at", "hole.word")
    found = holes.join(rare.select("word", F.col("ids").alias("more")), "word", "left")
    piece = F.struct("nth", "at", "more", F.when(F.col("more").isNull(), F.col("word")).alias("word"))
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(piece)).alias("found"))
    open_rows = coded.where(F.size("holes") > 0).join(found, "row").select("_doc", "ids", "found")
    schema = StructType([coded.schema["_doc"], StructField("ids", BinaryType())])

    def run(batch, _) -> dict:
        out = []
        for ids, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            once = iter(encode_all(path, [p["word"] for p in pieces if p["more"] is None]))
            edges = [0, *(4 * p["at"] for p in pieces)]
            more = (p["more"] if p["more"] is not None else next(once) for p in pieces)
            parts = [x for a, b, m in zip(edges, edges[1:], more) for x in (ids[a:b], m)]
            out.append(b"".join([*parts, ids[edges[-1] :]]))
        return {"_doc": batch.column(0), "ids": out}

    whole = coded.where(F.size("holes") == 0).select("_doc", "ids")
    return whole.unionByName(map_columns(open_rows, run, schema, rows=64))


def _bytes_of() -> dict[str, int]:
    """Byte of each character in which a byte-level vocabulary is written: printable Latin-1
    characters stand for themselves, the other bytes for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def piece_table(path: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of every piece of the vocabulary, added tokens included."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    byte = _bytes_of()
    pieces = {i: p for p, i in data["model"]["vocab"].items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
    return [(i, bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode()) for i, p in sorted(pieces.items())]


class Pieces:
    """The bytes of all pieces in one array; unknown ids are empty."""

    def __init__(self, table: list[tuple[int, bytes]]):
        size = 1 + max((i for i, _ in table), default=-1)
        self.sizes = np.zeros(size + 1, np.int64)
        by_id = dict(table)
        self.sizes[:size] = [len(by_id.get(i, b"")) for i in range(size)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)

    def text(self, ids: bytes) -> str:
        numbers = np.minimum(np.frombuffer(ids, "<u4").astype(np.int64), len(self.sizes) - 1)
        parts = []
        for a in range(0, len(numbers), DECODED):
            rows = numbers[a : a + DECODED]
            parts.append(gather(self.bytes, self.starts[rows], self.sizes[rows]).tobytes())
        return b"".join(parts).decode("utf-8", errors="replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(``_doc``, ids, text): ``encoded`` with the text of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(piece_table(path))  # the vocabulary
    schema = StructType([encoded.schema["_doc"], encoded.schema["ids"], StructField("text", StringType())])

    def run(batch, state) -> dict:
        return {"_doc": batch.column(0), "ids": batch.column(1), "text": [state.text(x) for x in batch.column(1).to_pylist()]}

    return map_columns(encoded.select("_doc", "ids"), run, schema, lambda: Pieces(shared.value), rows=256)


def digests(decoded: DataFrame) -> DataFrame:
    """(``_doc``, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select(
        "_doc",
        (F.octet_length("ids") / 4).cast(LongType()).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
