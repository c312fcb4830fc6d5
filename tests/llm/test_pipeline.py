import corpus_pipeline
from atelier.llm import chunk_dedup, simhash
from tests.llm.test_chunk_dedup import slow_spans
from tests.llm.test_line_dedup import brute
from tests.llm.test_simhash import slow_components


def collect(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, documents, odd):
    stages = dict(corpus_pipeline.STAGES)
    docs = documents.unionByName(odd.withColumn("doc_id", odd.doc_id + 10**6))
    before = collect(docs)
    kept = stages["language_id"](spark, docs, "").cache()
    after = collect(kept)
    assert kept.columns == docs.columns and set(after) <= set(before) and not {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 8} & set(after)
    assert len([d for d in before if d < 10**6 and d not in after]) <= 0.02 * documents.count()
    lines = stages["line_dedup"](spark, kept, "").cache()
    gone = {(d, i) for d, i, *_, removed in brute(list(after.items())) if removed}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in after.items()}
    assert collect(lines) == want and lines.columns == docs.columns
    near = stages["near_dedup"](spark, lines, "").cache()
    sets = {d: simhash.shingles(t, 5) for d, t in want.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = {d: want[d] for d, c in slow_components(links, sets).items() if d == c}
    assert collect(near) == want
    chunks = stages["chunk_dedup"](spark, near, "").cache()
    out = dict(want)
    for d, a, b, _ in sorted(slow_spans(list(want.items()), chunk_dedup.LEAST), key=lambda s: (s[0], -s[1])):
        out[d] = out[d][:a] + out[d][b:]
    assert collect(chunks) == out and chunks.columns == docs.columns
    packed = stages["packing"](spark, chunks, "").collect()
    assert {r.doc_id for r in packed} == set(out)


def test_run(spark, tmp_path, odd):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_short_texts_keep_their_language(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "en", 0.498), (2, "en", 0.2), (3, "und", 0.9)], "doc_id long, lang_pred string, score double")
    monkeypatch.setattr(corpus_pipeline.kernel_langid, "identify", lambda d: d)
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "").collect()] == [1]


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", 7, "x", True, 3), (2, "123 456", "en", 8, "y", False, 4)], "doc_id long, text string, lang string, score int, Lang_pred string, held_out boolean, `a.b` int")
    for name in ("language_id", "line_dedup", "near_dedup", "chunk_dedup"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.collect() if r.doc_id == 1] == [tuple(docs.collect()[0])]


def test_near_dedup_loses_no_text(spark):
    rows = [(None, "a text without a key that no other row has"), (1, "two equal rows of one key and text"), (1, "two equal rows of one key and text"), (1, "the first of two copies is here now"), (2, "the first of two copies is here now"), (2, "another text of the second key alone")]
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, out), key=str) == sorted({rows[0], rows[1], rows[3], rows[5]}, key=str)
