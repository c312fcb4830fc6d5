import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atelier.llm import tree_bpe
from atelier.llm.vector_packing import Capacity, assign, pack, plan


def check_plan(lengths, capacity):
    bins = defaultdict(list)
    for length, a, b, first, offset in plan(dict(Counter(lengths)), capacity):
        for k in range(b - a):
            bins[first + k].append((offset, length, a + k))
    placed = Counter((n, r) for x in bins.values() for _, n, r in x)
    assert placed == Counter((n, r) for n, c in Counter(lengths).items() for r in range(c))
    for x in bins.values():
        at = 0
        for offset, n, _ in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity.tokens and len(x) <= capacity.documents and sum(n * n for _, n, _ in x) <= capacity.cost
    return len(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.sampled_from(["norm", "dot"]), st.integers(1, 6), st.integers(2500, 6000))
def test_plan_keeps_every_constraint(lengths, rule, documents, cost):
    check_plan(lengths, Capacity(50, documents, cost, rule=rule))


def test_plan_is_close_to_the_bound():
    lengths = np.random.default_rng(1).integers(1, 2048, 3000).tolist()
    assert check_plan(lengths, Capacity()) <= 1.01 * -(-sum(lengths) // 2048) + 1


def test_pack(spark, documents, odd):
    codec = tree_bpe.codec()
    for docs in (documents, odd):
        ids = {r.doc_id: np.append(codec.encode(r.text), 0).astype("<u4") for r in docs.collect()}
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in pack(docs).collect():
            by_doc[r.doc_id].append(r)
            by_sequence[r.sequence_id].append((r.offset, r.length))
        assert by_doc.keys() == ids.keys()
        for doc_id, rows in by_doc.items():
            rows.sort(key=lambda r: r.piece)
            assert [r.piece for r in rows] == list(range(len(rows)))
            at = 0
            for r in rows:
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[doc_id][at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids[doc_id]) and all(r.length == 2048 for r in rows[1:])
        for spans in by_sequence.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(by_sequence) <= 1.05 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_empty_and_repeated_rows(spark, odd):
    assert pack(odd.limit(0)).count() == 0
    twice = odd.union(odd).withColumn("length", odd["doc_id"])
    assert pack(twice).count() == 2 * pack(odd).count()
    with pytest.raises(ValueError):
        plan({9: 1}, Capacity(8))


def test_string_keys_and_clashing_names(spark):
    rows = [("a", "one two three"), ("b", None), ("c", "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("salt", F.lit(1))
    got = pack(docs).collect()
    assert {r.doc_id for r in got} == {"a", "b", "c"} and max(r.length for r in got) == 2048


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_each_constraint_binds_on_a_whole_table(spark, documents, rule):
    """Sequences are full by documents, by cost or by tokens, and never over."""
    full = {"n": 3, "c": 256 * 256, "t": 256}
    for binds, capacity in (("n", Capacity(256, 3, 256**3, rule=rule)), ("c", Capacity(256, 256, 256 * 256, rule=rule)), ("t", Capacity(256, 256, 256**3, rule=rule))):
        sequences = pack(documents, capacity).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t"), F.sum(F.col("length") ** 2).alias("c"))
        rows = sequences.collect()
        assert all(r.n <= capacity.documents and r.t <= capacity.tokens and r.c <= capacity.cost for r in rows)
        assert any(r[binds] == full[binds] and r.n > 1 or r[binds] > 0.9 * full[binds] and r.n > 1 for r in rows)
