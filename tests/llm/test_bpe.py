"""BPE encoding and decoding against the public tokenizer."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabscope.llm import bpe
from tabscope.llm.common import read_table
from tabscope.llm.queries import QUERIES, public_tokens


@pytest.fixture(scope="module")
def path():
    return public_tokens().path


def plain(path, text):
    t = bpe.tokenizer(path)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_query_equals_the_tokenizer(spark, sf_dir, path):
    texts = {r.doc_id: r.text for r in read_table(spark, sf_dir, "documents").collect()}
    table = QUERIES["op11_bpe"](spark, sf_dir)
    rows = table.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = plain(path, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))
    assert table.count() == len(rows)
    for c in table.columns:
        assert sorted(map(str, (r[c] for r in table.select(c).collect()))) == sorted(str(r[c]) for r in rows)


#: White space of many kinds, controls, marks, digits of several scripts, contractions, special tokens.
SIGNS = [
    " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "᠎", " ", "​", " ",
    " ", " ", " ", "　", "﻿", "\x00", "a", "bc", "the", "don't", "'s", "'", "12", "½", "٣", "é", "é", "ß", "漢字",
    "😀", "👩‍👩", "\U0001fae8", "\U0001e900", "", ".", "...", "<|endoftext|>", "<|", "|>", "-", "\\", "_",
]


@pytest.mark.parametrize("limit", [0, 700, bpe.BYTES])
def test_any_text_and_any_share_of_broadcast_words(spark, path, limit):
    rng = random.Random(11)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 30))) for _ in range(1_500)]
    texts += [None, "", " ", "\n \n", "<|endoftext|>", "x" * 100_000, "word " * 20_000, "one " + "y" * 90_000, "two " + "y" * 90_000, " lead", "trail "] + ["the same words here"] * 700
    rows = [(i, t, i % 3, b"x", "y") for i, t in enumerate(texts)] + [(None, "null id", 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, holes binary, word string").repartition(5)
    encoded = bpe.encode(docs, path, limit=limit)
    words = bpe.word_table(docs, path)
    assert (bpe.least_step(words, limit) is None) == (limit == bpe.BYTES)
    got = bpe.decode(encoded, path).collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t, *_ in rows}
    for r in got:
        ids, text = plain(path, by_id[r["_doc"].doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, repr(by_id[r["_doc"].doc_id])[:200]
        assert r.text == text == (by_id[r["_doc"].doc_id] or "")
        assert r["_doc"].asDict().keys() == {"doc_id", "ids", "holes", "word"}


def test_words_that_come_twice_are_encoded_once(spark, path):
    docs = spark.createDataFrame([("a b a\nb",), ("a b",), (None,)], "text string")
    words = bpe.word_table(docs, path)
    assert sorted((r.word, r.n) for r in words.collect()) == [(" b", 2), ("a", 2)]


def test_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(bpe, "xxh64_intdigest", lambda w: len(w))
    known = bpe.Known(bpe.packed(pa.table({"word": ["ab", "c", "cd", "ef"], "ids": [b"1111", b"2222", b"33334444", b""]})))
    rows = known.place(pa.array(["cd", "x", "ab", "c", "ef", "gh", "long"]))
    assert [known.words[int(r)].as_py() if r >= 0 else None for r in rows] == ["cd", None, "ab", "c", "ef", None, None]
    assert known.sizes[rows[rows >= 0]].tolist() == [2, 1, 1, 0]


def test_ids_beyond_two_bytes():
    known = bpe.Known(bpe.packed(pa.table({"word": ["ab"], "ids": [np.array([7, 100_000], "<u4").tobytes()]})))
    assert known.ids.tolist() == [7, 100_000]


def test_broken_bytes_are_replaced(path):
    pieces = bpe.Pieces(bpe.piece_table(path))
    t = bpe.tokenizer(path)
    rng = np.random.default_rng(2)
    for ids in [*rng.integers(0, 50257, (300, 12)).tolist(), t.encode("漢字").ids[:1], t.encode("😀").ids[1:], [50256, 50256]]:
        assert pieces.text(np.array(ids, "<u4").tobytes()) == t.decode(ids, skip_special_tokens=False)


def test_no_documents(spark, path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(docs, path), path)).count() == 0
    assert docs.select(F.explode(bpe.split_words(F.col("text")))).count() == 0
