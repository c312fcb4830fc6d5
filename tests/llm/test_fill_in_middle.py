import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atelier.llm import fill_in_middle as f
from tests.llm.conftest import SF

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(doc_id, text):
    """n, form, prefix_chars, middle_chars and output by the contract's words."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\nabé\U0001f600 ", max_size=60), st.integers(0, 2**32), st.integers(0, 2**32), st.integers(1, 9))
def test_cuts(text, first, second, size):
    units = UNIT.findall(text)
    a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    assert f.cuts(text, first, second, size) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))


def test_descent_finds_every_block():
    counts = np.array([[0, 3, 0, 0, 2, 1, 0, 7, 0], [4] * 9])
    tree, sums = f.Fenwick(counts), np.cumsum(counts[0])
    for k in range(1, 14):
        block, held = tree.descend(k)
        want = int(np.searchsorted(sums, k))
        assert (block, held.tolist()) == (want, [int(counts[0, :want].sum()), 4 * want])


def test_rows(spark, odd):
    tags = [(100 + i, t) for i in range(40) for t in (f"a<P>b {i}", "a < P> b< S <", f" x{i}  y\nz ", "<" * i + " S> M>", "w " * (i * 700))]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([*tags, (None, "no key here")], "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in f.transform(df).collect()), key=str)
    assert got == sorted(((r.doc_id, r.text, *slow(r.doc_id, r.text)) for r in df.collect()), key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    back = f.transform(df).select("text", f.restored(f.F.col("output"), f.F.col("form")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_table_against_sql(spark, documents):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.execute(f.ORACLE)
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, f.digests(documents).select(*names).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", ["n", "form", "output", "whole", "found", "a.b"])
def test_clashing_columns_and_empty_tables(spark, name):
    df = spark.createDataFrame([(1, "a b c", 5)], f"doc_id long, text string, `{name}` int")
    row = f.transform(df).collect()[0]
    assert row.n == 3 and len(row) == (8 if name not in f.RESULTS else 7)
    assert f.transform(df.limit(0)).count() == 0
