import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from atelier.llm import viterbi_counts as v


def library(pieces, fallback):
    t = Tokenizer(models.Unigram(pieces, 0, fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return t


SMALL = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("ba", -2.5), ("aba", -3.5), ("▁a", -3.0), ("bb", -3.0), ("c▁", -1.0)]
BYTES = [(f"<0x{b:02X}>", -9.0) for b in range(256)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ▁cé\n漢", max_size=40), st.booleans())
def test_small_vocabulary(text, fallback):
    pieces = SMALL + BYTES if fallback else SMALL
    assert v.Counter(pieces)(text) == len(library(pieces, fallback).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", " ", "  a  b", "don't\tstop\n\nnow " * 30, "aaaa" * 900, "漢字 \U0001f600 é", "<0x41> <unk> </s>"])
def test_whole_vocabulary(text):
    pieces = v.load()
    assert v.Counter(pieces)(text) == len(library(pieces, True).encode(text, add_special_tokens=False).ids)


def test_documents(spark, documents, odd):
    lib = library(v.load(), True)
    for docs in (documents, odd, odd.limit(0)):
        rows = v.count_tokens(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r.n_tokens == (len(lib.encode(r.text, add_special_tokens=False).ids) if r.text else 0)


def test_one_unit_holds_few_positions():
    """A long text without spaces is one unit; its memory does not grow with it."""
    import tracemalloc

    pieces = v.load()
    count, text = v.Counter(pieces), "abcdefghij漢" * 40_000
    tracemalloc.start()
    n = count(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(library(pieces, True).encode(text, add_special_tokens=False).ids)
    assert peak < 16 * len(text)
