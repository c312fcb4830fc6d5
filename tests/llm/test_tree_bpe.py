import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atelier.llm import tree_bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
CODEC = tree_bpe.codec()


def whole(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    [
        "",
        "don't stop " * 300,
        "a" * 5000,
        "abracadabra" * 700,
        " " * 3000 + "x" + "\n" * 900 + " y",
        "12345" * 500 + "'ll'll've" * 200,
        "<|endoftext|>" * 300 + "<|endoftext|" + "é漢字\U0001f600" * 300,
        "THE quick\t\tbrown  fox's jump\r\n" * 200,
    ],
)
@pytest.mark.parametrize("leaf", [50, 333, 2048])
def test_tree_equals_one_pass(text, leaf):
    ids = CODEC.encode(text, leaf)
    assert ids.tolist() == whole(text)
    assert CODEC.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the ", "ing", "a", "'s", "  ", "\n", "é", "9", "!!", "<|endoftext|>", "Xy", "漢"]), max_size=400))
def test_tree_on_random_texts(pieces):
    text = "".join(pieces)
    assert CODEC.encode(text, 40).tolist() == whole(text)


def test_query_columns(spark, documents, odd):
    for docs in (documents, odd.withColumn("ids", odd["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        rows = tree_bpe.digests(docs).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = whole(texts[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(odd):
    assert tree_bpe.digests(odd.limit(0)).count() == 0


def test_branches_are_rows(spark, odd):
    """Long texts leave their row: equal rows, null keys and columns of any name come back whole."""
    texts = ["abracadabra " * 400, "x" * 3001, " " * 2000 + "don't <|endoftext|> " * 150, None, "", "short", "é漢\U0001f600'll " * 500]
    rows = [(i % 3 or None, t, 7) for i, t in enumerate(texts + texts[:2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").withColumn("row", F.lit(1)).withColumn("whole", F.lit(2))
    coded = tree_bpe.encode(docs, leaf=50, branch=400)
    assert coded.columns == ["doc_id", "text", "a.b", "row", "whole", "ids"]
    got = sorted((r.doc_id or 0, r.text or "", np.frombuffer(r.ids, "<u4").tolist(), r["a.b"], r.row, r.whole) for r in coded.collect())
    assert got == sorted((d or 0, t or "", whole(t or ""), 7, 1, 2) for d, t, _ in rows)


def test_branches_are_dealt_apart(spark):
    docs = spark.createDataFrame([(1, "one long text " * 5000)], "doc_id long, text string")
    plan = tree_bpe.encode(docs, branch=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "hashpartitioning(row" in plan and ", at" in plan
