import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from atelier.llm import host_rules


def slow(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if count[g] > 1 for o in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures(spark, documents, odd):
    many = spark.createDataFrame([(900, " ".join(f"w{i % 70} v{i % 70}" for i in range(400)), "en", "s", 1)], odd.schema)
    clash = odd.withColumn("host", odd["doc_id"]).withColumn("n_docs", odd["doc_id"])
    for docs in (documents, clash, many):
        texts = {r.doc_id: r.text for r in docs.collect()}
        rows = host_rules.apply_rules(docs).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert tuple(r[n] for n in NAMES) == slow(texts[r.doc_id])
            assert not (r.kept and r.base_failed)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#\t", max_size=60), min_size=1, max_size=20))
def test_measures_of_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in host_rules.measured(docs).collect():
        assert tuple(r[n] for n in NAMES) == slow(r.text)


def test_bad_host_is_dropped(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good if i % 50 else "short", f"h{i % 7}") for i in range(700)] + [(1000 + i, "spam " * 100 if i % 20 else good, "bad") for i in range(200)]
    out = {r.doc_id: r for r in host_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[1000 + i].kept for i in range(200))
    assert all(out[i].kept == (i % 50 != 0) for i in range(700))


def test_oracle(spark, documents):
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    want = sorted(con.sql(f"select doc_id, n_repeat_words, host_rate, kept from ({host_rules.ORACLE})").fetchall())
    got = sorted((r.doc_id, r.n_repeat_words, r.host_rate, r.kept) for r in host_rules.apply_rules(documents).collect())
    assert got == want


def test_empty_table(odd):
    assert host_rules.apply_rules(odd.limit(0)).count() == 0
