"""Fill-in-middle against a plain regular expression, with chunks of any size."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import middle

ROWS = [
    (1, "one\ntwo\nthree\n"), (2, "no feed at the end\nlast"), (3, ""), (4, None), (5, "\n\n\n\n"), (6, "has <M> inside\nx"), (7, "almost <M and <S\n> and <"),
    (8, "Ünï\ncödé\n日本語\n" * 40), (9, "a" * 5000), (10, "line\n" * 2000 + "<" + "P>"), (11, "x<\nS>\n"), (None, "without\nid\n"), (None, None), (2, "no feed at the end\nlast"),
    (12, "\n".join(f"{k} <P {k} M> <<" for k in range(900))),
]


def plain(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    if not text or re.search("<[PSM]>", text):
        return (doc_id, n, "plain", None, None, text)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:z], lines[z:]))
    spm = h4 % 100 < 50
    return (doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [1 << 18, 64, 5])
def test_documents_against_a_regular_expression(spark, chunk, monkeypatch):
    monkeypatch.setattr(middle, "GROUP", 7)
    rows = [r for r in ROWS if chunk > 5 or len(r[1] or "") < 1500]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("raw", "row", "part", "output", "form", "prefix", "n")})
    got = middle.fill_in_middle(docs, chunk=chunk).withColumn("back", middle.restored()).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)


def test_percentages_and_empty_table(spark):
    docs = spark.createDataFrame([(k, "a\nb\nc\n") for k in range(200)], "doc_id long, text string")
    assert {r.form for r in middle.fill_in_middle(docs, fim=0).collect()} == {"plain"}
    assert {r.form for r in middle.fill_in_middle(docs, spm=100).collect()} == {"spm"}
    assert middle.fill_in_middle(docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text("\n<PSM> xé", max_size=60), st.lists(st.integers(0, 80), max_size=8))
def test_functions_of_chunks_compose_to_that_of_the_text(text, cuts):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.array(sorted({0, *(c for c in cuts if c <= len(data))}), np.int64)
    whole = middle.functions(data, np.zeros(1, np.int64))[0]
    f = middle.IDENTITY[None]
    for g in middle.functions(data, starts):
        f = middle.compose(f, g[None])
    assert (f[0] == whole).all()
    assert whole[1, 0] == len(re.findall(r"[^\n]*\n|[^\n]+", text)) and whole[2, 0] == len(re.findall("<[PSM]>", text))
