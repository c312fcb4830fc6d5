import random
import zlib
from collections import defaultdict

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from atelier.llm import chunk_dedup as c


def text_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghié", k=rng.randint(2, 8))) for _ in range(n))


def slow_hash(data, i):
    return sum(int(c.GEAR[data[i - j]]) << j for j in range(min(16, i + 1))) & 0xFFFF


def slow_spans(rows, least):
    first, pieces = {}, {}
    for doc, text in sorted({(d, t) for d, t in rows if t}, key=lambda r: (r[0], zlib.crc32(r[1].encode()))):
        data = text.encode()
        at = c.borders(data)
        pieces[doc, text] = [data[a:b] for a, b in zip(at, at[1:])]
        for n, p in enumerate(pieces[doc, text]):
            first.setdefault(xxhash.xxh3_128_digest(p), (doc, zlib.crc32(data), n))
    found = set()
    for (doc, text), ps in pieces.items():
        run, start = [], 0
        for n, p in [*enumerate(ps), (len(ps), None)]:
            if p is not None and first[xxhash.xxh3_128_digest(p)] != (doc, zlib.crc32(text.encode()), n):
                run.append((start, p))
            else:
                if sum(len(x) for _, x in run) >= least:
                    found.add((doc, run[0][0], run[-1][0] + len(run[-1][1].decode()), first[xxhash.xxh3_128_digest(run[0][1])][0]))
                run = []
            start += len(p.decode()) if p else 0
    return found


def test_borders_follow_content():
    data = text_of(1, 800).encode()
    at = c.borders(data)
    assert at[0] == 0 and at[-1] == len(data) and at == sorted(set(at))
    for a, b in zip(at[:-1], at[1:-1]):
        assert c.SMALLEST <= b - a <= c.LARGEST + 3
        data[a:b].decode()
    hits = [i for i in range(len(data)) if slow_hash(data, i) < 1 << (16 - c.BITS)]
    assert set(at[1:-1]) <= {x + k for i in hits for x in (i + 1,) for k in range(4)} | {a + k for a in at for k in range(c.LARGEST, c.LARGEST + 4)}
    shifted = c.borders(b"inserted text " + data)
    assert len({x - 14 for x in shifted} & set(at)) > 0.9 * len(at)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé漢\U0001f600", max_size=700))
def test_borders_of_wide_characters(text):
    data = text.encode()
    at = c.borders(data)
    assert b"".join(data[a:b] for a, b in zip(at, at[1:])) == data and at == sorted(set(at))
    for a, b in zip(at, at[1:]):
        data[a:b].decode()


def test_spans(spark, documents, odd):
    for docs in (documents, odd, odd.union(odd).withColumn("sum", odd.doc_id), odd.limit(0)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = [(r.doc_id, r.start, r.stop, r.first_doc_id) for r in c.spans(docs).collect()]
        assert len(got) == len(set(got)) and set(got) == slow_spans(rows, c.LEAST)


def test_passages_are_cut_and_clean_texts_stay(spark):
    passage = text_of(9, 55)
    rows = [(i, text_of(100 + i, 150) + (" " + passage + " " if i % 10 == 0 else " ") + text_of(900 + i, 80), "x") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d1 string")
    hit = {r.doc_id for r in c.spans(docs).collect()}
    assert hit == {i for i in range(10, 100, 10)}
    out = {r.doc_id: r for r in c.without_repeats(docs).collect()}
    assert out.keys() == {r[0] for r in rows} and out[5].d1 == "x"
    assert sum(passage in r.text for r in out.values()) == 1
    assert all(out[i].text == t for i, t, _ in rows if i not in hit)


def test_rewrite_of_odd_rows(spark, odd):
    docs = odd.union(odd)
    out = c.without_repeats(docs)
    assert out.columns == odd.columns and out.count() == docs.count()
    by_id = defaultdict(set)
    for r in out.collect():
        by_id[r.doc_id].add(r.text)
    assert all(len(t) == 1 for t in by_id.values()) and by_id[0] == {None} and by_id[1] == {""}


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    text = text_of(5, 80)
    docs = spark.createDataFrame([(1, text), (2, "Other. " + text)], "doc_id long, text string")
    docs = docs.select("*", *[F.lit(1).alias(n) for n in ("doc", "sum", "spans", "_doc", "_sum", "_spans", "n", "start")])
    out = c.without_repeats(docs)
    assert out.columns == docs.columns
    assert [len(r.text) < len(text) for r in out.orderBy("doc_id").collect()] == [False, True]
