"""Search inside outputs against a plain ranking, exact ranges and limits."""

import math
import sqlite3

import pytest

from corpusmill.operators import output_search, rank, streams

LINES = ["some words here", "cc-by licensed under the License", "a license: cc by", "ünder the söme CC-BY text", "plain"]


def text(seed, n):
    return "\n".join(LINES[(k * k // (5 + seed) + k // 70) % 5 if k // 50 % 2 else 0] for k in range(n)) + "\n" * (seed % 2)


def fts(raw, phrases):
    """The same regions ranked by SQLite's full-text index over expanded tokens."""
    from corpusmill.functions import words

    known = words.Vocabulary(underscore=False)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE c USING fts5(body)")
    for i, (s, e, _) in enumerate(streams.regions(raw)):
        db.execute("INSERT INTO c(rowid, body) VALUES (?, ?)", (i + 1, " ".join(known.terms[t] for t in known.sequence(raw[s:e].decode()))))
    ask = " OR ".join('"' + " ".join(p) + '"' for p in phrases)
    return sorted(((round(-s, 9), i - 1) for i, s in db.execute("SELECT rowid, bm25(c) FROM c WHERE c MATCH ?", (ask,))), key=lambda x: (-x[0], x[1]))[:5]


def test_ranking_and_ranges(spark):
    rows = [(k, text(k, n)) for k, n in enumerate([800, 500, 130, 40, 3])] + [(8, None), (9, ""), (10, "nothing of it"), (3, text(3, 40))]
    query = "cc-by license"
    phrases, terms = rank.query_phrases(spark, query, underscore=False), rank.query_terms(spark, query)
    assert ["cc", "by"] in phrases
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "1 AS place", "2 AS raw", "3 AS handle")
    got = output_search.searched(df, "id", "text", phrases, terms).collect()
    for i, t in rows[:5]:
        raw = t.encode()
        want = fts(raw, phrases)
        mine = sorted({(r.place, r.position, r.score) for r in got if r.id == i})
        assert [p for _, p, _ in mine] == [p for _, p in want] and all(math.isclose(s, w, abs_tol=2e-9) for (_, _, s), (w, _) in zip(mine, want))
        for r in (r for r in got if r.id == i):
            s, e, _ = streams.regions(raw)[r.position]
            assert s <= r.start <= r.end <= e and raw[r.start : r.end].decode() == r.excerpt
            assert r.first_line == raw[: r.start].count(b"\n") + 1 and r.last_line == raw[: max(r.end - 1, 0)].count(b"\n") + 1
            assert (r.clipped_before, r.clipped_after) == (r.start > s, r.end < e) and len(r.excerpt.encode()) <= 1000
    assert {r.id for r in got} <= {0, 1, 2, 3, 4} and sum(r.id == 3 for r in got) == 2 * len({r.position for r in got if r.id == 3})


def test_limits_are_errors(monkeypatch):
    from corpusmill.functions import words

    raw = text(1, 900).encode()
    ask = lambda: output_search._best(raw, words.Vocabulary(False), [["license"]], ["license"], 5)
    assert ask()
    for name, value in (("REGION_TOKENS", 100), ("STREAM_TOKENS", 5000)):
        with monkeypatch.context() as m:
            m.setattr(output_search, name, value)
            with pytest.raises(output_search.LimitExceeded, match="tokens"):
                ask()
    monkeypatch.setattr(streams, "REGIONS", 3)
    with pytest.raises(output_search.LimitExceeded, match="regions"):
        ask()


def test_bytes_of_tokens():
    from corpusmill.functions import words

    known = words.Vocabulary(False)
    for t in ("fooBar baz_qux é", "", "--", "a a a"):
        joined = " ".join(x for w in t.split() for x in known.tokens(w))
        assert known.measured(t)[1] == len(joined.encode())


def test_more_words_than_are_remembered(monkeypatch):
    from corpusmill.functions import words

    monkeypatch.setattr(words.Vocabulary, "MOST", 3)
    known, fresh = words.Vocabulary(False), words.Vocabulary(False)
    for t in ("a b c", "a b c d e", "a b c d e", "f a", "e d f"):
        known.trim()
        (mine, size), (want, same) = known.measured(t), fresh.measured(t)
        assert [known.terms[k] for k in mine] == [fresh.terms[k] for k in want] == t.split() and size == same == len(t)
