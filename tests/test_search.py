"""Tokens, windows, policy and ranking against goldens and SQLite's FTS5."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking, policy, rank


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("validateRefreshToken", ["validaterefreshtoken", "refresh", "token", "validate"]),
        ("HTTPServer", ["httpserver", "http", "server"]),
        ("snake_case", ["snake_case", "case", "snake"]),
        ("kebab-case", ["kebab-case", "case", "kebab"]),
        ("src/auth/token.ts", ["src/auth/token.ts", "auth", "src", "token", "ts"]),
        ("refresh refresh", ["refresh", "refresh"]),
        ("--x9Y--", ["x9y", "x9", "y"]),
        ("\"'()*", []),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text))) == want


def test_query_admission(spark):
    assert rank.query_terms(spark, "token OR refresh") == ["or", "refresh", "token"]
    for bad in ("()*", "x" * 2001):
        with pytest.raises(ValueError):
            rank.query_terms(spark, bad)
    assert len(rank.query_terms(spark, " ".join(f"t{i}" for i in range(50)))) == 32


def test_windows(spark):
    df = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(130))), (2, "  \n"), (3, ""), (4, None)], "id int, text string")
    got = [(r.id, r.start_line, r.end_line) for r in chunking.line_windows(df, "id", "text").orderBy("id", "start_line").collect()]
    assert got == [(1, 1, 60), (1, 55, 114), (1, 109, 130)]


def test_lines(spark):
    for text, want in [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n\n", ["a", "b", ""]), ("\n", [""])]:
        assert one(spark, T.lines(F.lit(text))) == want
    for text, want in [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2)]:
        assert one(spark, T.retained_lines(F.lit(text))) == want


def test_regions():
    text = "import x\nexport class A {\n  f() {\n    return 1;\n  }\n  g = 2;\n}\nexport function h() {\n}\nconst k = 1;\n"
    assert chunking.regions(text, "ts") == [(2, 2, "A"), (3, 5, "A.f"), (6, 6, "A.g"), (8, 9, "h"), (10, 10, "k")]


def test_policy(spark):
    rules = policy.compile_rules("*.log\n!keep.log\n/only/here/\nvendor2/\n!node_modules/\n")
    cases = {
        "a/b.ts": False, "x/.git/y": True, ".searchignore": True, "a/x.log": True, "a/keep.log": False, "only/here/z": True, "b/only/here/z": False,
        "q/vendor2/z": True, "node_modules/z": False, "vendor/z": True, "vendor": False, "a/yarn.lock": True, "build/a/b": True,
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string").withColumn("x", policy.excluded(F.col("path"), rules))
    assert {r.path: r.x for r in df.collect()} == cases
    with pytest.raises(ValueError):
        policy.compile_rules("a\n" * 257)


def test_skip_reasons(spark):
    cases = [(b"ok\n", None), (b"a\0b", "binary"), (b"\xff", "invalid_utf8"), (b"x" * (512 * 1024 + 1), "file_too_large"), (b"y" * 4001, "line_too_long"), (b"a\n" * 12001, "too_many_lines")]
    df = spark.createDataFrame([(bytearray(c),) for c, _ in cases], "c binary").select(policy.skip_reason(F.col("c")).alias("r"))
    assert [r.r for r in df.collect()] == [w for _, w in cases]


def test_safe_path_and_globs(spark):
    cases = {"a/b": True, "/a": False, "a/../b": False, "a//b": False, "a\\b": False, ".git/x": False, "a/.gitx": True, "": False, "a\n": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", T.safe_path(F.col("p")).alias("x"))
    assert {r.p: r.x for r in df.collect()} == cases
    import re

    assert re.match(T.glob_pattern("src/**/*.ts"), "src/a/b/c.ts") and re.match(T.glob_pattern("src/**/*.ts"), "src/c.ts")
    assert not re.match(T.glob_pattern("src/*.ts"), "src/a/c.ts")


def test_bm25_equals_fts5(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.concat_ws(" ", "source", "lang").alias("symbol"), "text")
    shown = docs.withColumn("s", T.searchable(F.col("symbol"))).withColumn("t", T.searchable(F.col("text"))).collect()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE x USING fts5(symbol, body, tokenize = \"unicode61 tokenchars '_'\")")
    db.executemany("INSERT INTO x(rowid, symbol, body) VALUES (?, ?, ?)", [(r.doc_id + 1, r.s, r.t) for r in shown])
    posted = rank.postings(docs, "doc_id", {"symbol": "symbol", "body": "text"})
    for terms in (["the"], ["license", "en"], ["ciónñ", "src1", "thing"]):
        want = dict(db.execute("SELECT rowid - 1, -bm25(x, 8.0, 1.0) FROM x WHERE x MATCH ?", [" OR ".join(f'"{t}"' for t in terms)]).fetchall())
        folded = [one(spark, T.fold(F.lit(t))) for t in terms]
        got = {r.doc_id: r.score for r in rank.bm25(posted, docs, "doc_id", folded, {"symbol": 8.0, "body": 1.0}).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_phrases_count_overlaps(spark):
    df = spark.createDataFrame([(1, "a a a"), (2, "x-y x y z"), (3, "y x")], "id int, text string")
    got = {(r.id, r.phrase): r.n for r in rank.phrase_counts(df, "id", "text", [["a", "a"], ["x", "y"]]).collect()}
    assert got == {(1, "a a"): 2, (2, "x y"): 3}  # x-y and its components, then the two words


def test_phrases_of_a_batch_take_one_pass_and_stay_in_their_text(spark):
    rows = [(1, "cc"), (2, "by cc"), (3, None), (4, ""), (5, "by"), (6, "cc by cc by"), (6, "cc"), (None, "cc by")]
    found = rank.phrase_counts(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", "text", [["cc"], ["cc", "by"], ["by", "cc", "by"], ["none"]])
    got = sorted(((r.id or 0, r.phrase, r.n) for r in found.collect()))
    assert got == [(0, "cc", 1), (0, "cc by", 1), (1, "cc", 1), (2, "cc", 1), (6, "by cc by", 1), (6, "cc", 1), (6, "cc", 2), (6, "cc by", 2)]
    assert "Union" not in found._jdf.queryExecution().toString()


def test_upper_case_is_that_of_sql_letter_by_letter(spark):
    import duckdb

    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(map(chr, points[k : k + 4096])) for k in range(0, len(points), 4096)] + ["Straße", "ßß", "", "ŉaŉ", "ﬁn", "İi", "ΌΣΟΣ ὀδυσσεύς ᾳ"]
    got = [r.u for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.upper_by_letter(F.col("t")).alias("u")).collect()]
    assert got == [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]


def test_limits(spark):
    with pytest.raises(ValueError):
        rank.top(spark.createDataFrame([(1, 1.0)], "id int, score double"), 21, "id")


def test_arrow_tokens_equal_those_of_column_expressions(spark):
    from corpusmill.functions import words

    texts = ["getHTTPResponse2Code foo_bar cc-by/4.0 ÀÉÎ ñandú ΣΊΣΥΦΟΣ x", "", "__init__ $var. -- / a.b.c- 日本語テキスト ⅫVal ½x I’m", "snake_Case2Camel\nnew\tLine", "İstanbul Straße ǅ éclair"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for underscore in (True, False):
        tokens = F.flatten(F.transform(T.tokens(F.col("text")), lambda t: T.search_tokens(t, underscore)))
        known = words.Vocabulary(underscore)
        for row in df.select("text", tokens.alias("t")).collect():
            assert [known.terms[i] for i in known.sequence(row.text)] == list(row.t), row.text


def test_term_counts_of_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, "a b a", None), (2, None, "b"), (3, "", ""), (3, "a", "a")], "id long, body string, title string")
    got = sorted((r.id, r["len"], r.f0, r.f1) for r in rank.term_counts(rows, "id", {"body": "body", "title": "title"}, ["a", "b"], {"title": 2.0}).collect())
    assert got == [(1, 3, 2.0, 1.0), (2, 1, None, 2.0), (3, 0, None, None), (3, 2, 3.0, None)]
