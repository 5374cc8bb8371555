"""The stages of the corpus pipeline, each on what the one before kept."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tabscope.llm import packing, pii, simhash
from tabscope.llm.common import map_columns, read_table
from tabscope.llm.queries import public_tokens


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    docs = read_table(spark, sf_dir, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_stay(tables):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert tables[name].schema == tables["documents"].schema


def test_quality_keeps_unlabelled_rules(spark, sf_dir, tables):
    labels = read_table(spark, sf_dir, "labels")
    kept = tables["quality_rules"].join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 0.05 * labels.where("quality = 0").count()


def test_no_near_copies_stay(tables):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    before = {r.doc_id: shingles(r.text) for r in tables["quality_rules"].collect()}
    after = {r.doc_id for r in tables["near_dedup"].collect()}
    alike = lambda a, b: len(a & b) / len(a | b)
    ids = sorted(after)
    for i, a in enumerate(ids):
        assert all(alike(before[a], before[b]) < 0.9 for b in ids[:i])
    for gone in before.keys() - after:  # whatever goes has a near copy that was there
        assert max(alike(before[gone], s) for d, s in before.items() if d != gone) > 0.5


def test_personal_data_is_gone(tables):
    assert all(not pii.base_spans(r.text) for r in tables["pii"].collect())


def test_mixture_and_packing(tables):
    mixed = Counter(r.doc_id for r in tables["mixing"].collect())
    assert max(mixed.values()) <= 2
    packed = Counter(r.doc_id for r in tables["packing"].where("piece = 0").collect())
    assert packed == mixed


@pytest.mark.parametrize("module, stage", [(pii, pii.redact_rows), (simhash, simhash.keep_first)])
def test_texts_are_sent_to_workers_once(spark, monkeypatch, module, stage):
    sent = []
    monkeypatch.setattr(module, "map_columns", lambda df, *a, **b: sent.append(df.schema) or map_columns(df, *a, **b))
    rows = [(1, "call +1 (269) 555-3296 now", 26), (2, None, None), (3, "no number", 9), (3, "no number", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in stage(docs).collect() if r.text)
    assert got == ([(1, "call [PHONE] now"), (3, "no number"), (3, "no number")] if module is pii else [(1, rows[0][1]), (3, "no number")])
    assert sent[0].simpleString().count("text:string") == 1


def test_texts_that_are_no_strings_are_cast(spark):
    docs = spark.createDataFrame([(1, 4111111111111111), (2, 7), (3, 7), (4, None)], "doc_id long, text long")
    assert {r.doc_id: r.text for r in pii.redact_rows(docs).collect()} == {1: "[CARD]", 2: "7", 3: "7", 4: None}
    assert sorted(r.doc_id for r in simhash.keep_first(docs.where(F.col("doc_id") > 1)).collect()) == [2, 4]


def test_encoder_remembers_a_bounded_number_of_words():
    from tokenizers import Tokenizer

    tokens = public_tokens()
    tokenizer, ours = Tokenizer.from_file(tokens.path), packing.Encoder(*tokens)
    for start in range(0, 300_000, 10_000):
        text = "the " + " ".join(f"w{i:x}" for i in range(start, start + 10_000))
        (got,) = ours.encode([text])
        assert len(ours.known) <= 150_000
    assert got == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)
