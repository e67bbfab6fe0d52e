import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    """What the contract says of a row, written plainly."""
    t = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    u = UNIT.findall(t)
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, t
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def documents(odd):
    marks = ["a <P> b", "<", "<S", "x <M", "> y", "<<P >S> <", "a<\n<b", "\x1f \x85   x", " lead", "trail \r\n", "\x0b\x0c"]
    return odd + [(100 + 20 * k + j, t, None, None, None) for k, t in enumerate(marks) for j in range(20)]


def test_rows_against_plain_form(spark, folder, odd):
    docs = documents(odd)
    for most in (fim.in_bytes.__defaults__[0], 50):  # small batches too
        d = folder(extra=True, documents=docs)
        fim.in_bytes.__defaults__ = (most,)
        found = fim.filled_in_middle(fim.load(spark, d, "documents"))
        rows = found.withColumn("restored", fim.restored(found["output"], found["form"])).collect()
        assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted((expected(i, t) for i, t, *_ in docs), key=str)
        assert sorted(r["restored"] for r in rows) == sorted(t or "" for _, t, *_ in docs)
        assert {"plain", "psm", "spm"} == {r["form"] for r in rows}


def test_query_digests(spark, folder, odd):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = documents(odd)
    rows = fim.op13_fill_in_middle(spark, folder(extra=True, documents=docs)).collect()
    want = [(*r[:5], digest(r[5]), digest(t or "")) for (i, t, *_) in docs for r in [expected(i, t)]]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert fim.op13_fill_in_middle(spark, folder(documents=[])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0bab日<P>\x1f\x85", max_size=12), max_size=6))
def test_units_join_to_the_texts(texts):
    assert fim.units(pa.array(texts, pa.string())).to_pylist() == [UNIT.findall(t) for t in texts]


@pytest.mark.parametrize("doc_id", ["long", "string"])
def test_ids_of_other_types(spark, doc_id):
    docs = spark.createDataFrame([("7", "a b c d e f")], "doc_id string, text string").selectExpr(f"cast(doc_id as {doc_id}) doc_id", "text")
    assert tuple(fim.filled_in_middle(docs).first())[1:] == expected("7", "a b c d e f")[1:]
