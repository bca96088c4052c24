import hashlib
import random

from corpusmill.operators import audit, folds, requests


def replayed(events, steps):
    out = {}
    for key in {k for k, *_ in events}:
        state, broken, n = "", None, 0
        for _, kind in sorted((i, e or "") for k, i, e in events if k == key):
            state = steps.get((state, kind), "invalid")
            broken = n if state == "invalid" and broken is None else broken
            n += 1
        out[key] = (state, n, broken)
    return out


def test_logs_longer_than_a_range_and_a_batch(spark):
    rng = random.Random(5)
    steps = {("", "a"): "x", ("x", "a"): "x", ("x", "b"): "y", ("y", "a"): "x", ("y", "b"): ""}
    events = [("hot", i, rng.choice("aaab") if i != 2500 else "b") for i in range(3000)]
    events += [(None, i, "ab"[i % 2]) for i in range(700)] + [(f"k{rng.randrange(40)}", i, rng.choice(["a", "a", "a", "b", "z", None])) for i in range(300)]
    df = spark.createDataFrame(events, "k string, i long, e string").repartition(7)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as else the few rows meet in one range
    try:
        got = {r.k: (r.state, r.records, r.broken_at) for r in folds.replay_log(df, "k", ["i"], "e", steps).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
    assert got == replayed(events, steps)


def test_replay_agrees_with_the_ledger_fold(spark):
    rows = [("a", 1, "created"), ("a", 2, "planned"), ("a", 3, "started"), ("b", 1, "planned"), ("b", 2, "created"), ("c", 1, "created"), ("c", 1, "created")]
    df = spark.createDataFrame(rows, "k string, i int, e string")
    got = {r.k: (r.state, r.broken_at) for r in folds.replay_log(df, "k", ["i"], "e").collect()}
    assert got == {"a": ("started", None), "b": ("invalid", 0), "c": ("invalid", 1)}
    assert {k: s for k, (s, _) in got.items()} == {r.k: r.state for r in audit.replay(df, "k", ["i"], "e").collect()}
    assert folds.replay_log(df.limit(0), "k", ["i"], "e").collect() == []


def test_saved_summaries(spark):
    a = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), (None, "x", 1)], "k string, state string, records int")
    b = spark.createDataFrame([("a", "x", 1), ("b", None, 3), ("c", "x", 1)], "k string, state string, records int")
    got = {r.k: r.mismatches for r in folds.against_summary(a, b, "k", ["state", "records"]).collect()}
    assert got == {"b": ["state", "records"], "c": ["unlogged"], None: ["unsaved"]}


def merkle(items, width):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    hashed = [sha(i) if i is not None else "null" for i in items]
    level = [f"{h} {hashed.count(h)}" for h in sorted(set(hashed))]
    deep = 0
    while deep == 0 or len(level) > 1:
        level = [sha("\n".join(level[i : i + width])) for i in range(0, len(level), width)]
        deep += 1
    return level[0]


def test_digest_of_sets_does_not_depend_on_their_parts(spark):
    items = [("g", str(i % 70)) for i in range(200)] + [("g", None)] * 3 + [("h", "only"), (None, "x"), (None, "y")]
    for parts in (1, 5):
        df = spark.createDataFrame(random.Random(parts).sample(items, len(items)), "g string, item string").repartition(parts)
        got = {r.g: (r["items"], r.digest) for r in folds.merkle_digest(df, ["g"], df["item"], width=4).collect()}
        assert got == {k: (n, merkle([i for g, i in items if g == k], 4)) for k, n in (("g", 71), ("h", 1), (None, 2))}
    assert folds.merkle_digest(df.limit(0), ["g"], df["item"]).collect() == []


def test_order_statistics(spark):
    rng = random.Random(2)
    rows = [("wide", rng.gauss(0, 1e6)) for _ in range(3000)] + [("ties", float(rng.randrange(3))) for _ in range(2000)] + [("one", 4.0), (None, 1.0), (None, 2.0)]
    rows += [("wide", None), ("wide", float("nan")), ("none", None)] + [("big", x) for x in (float("inf"), float("-inf"), 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {"median": ("cont", 0.5), "p95": ("disc", 0.95), "least": ("disc", 0.0), "most": ("disc", 1.0)}
    got = {r.g: r for r in folds.order_statistics(df, ["g"], "v", want, most=10).collect()}
    assert set(got) == {"wide", "ties", "one", None, "none", "big"}
    for g, r in got.items():
        xs = sorted(v for k, v in rows if k == g and v is not None and v == v)
        assert r.n == len(xs)
        if not xs:
            assert (r.median, r.p95, r.least, r.most) == (None,) * 4
            continue
        low, high = xs[(len(xs) - 1) // 2], xs[len(xs) // 2]
        assert abs(r.median - (low + (high - low) / 2 if low != high else low)) < 1e-6
        assert (r.least, r.most, r.p95) == (xs[0], xs[-1], xs[max(-(-len(xs) * 95 // 100) - 1, 0)])


def test_instruction_blocks(spark):
    import json

    good = {
        "instructions": "base at /tmp/x",
        "input": [
            {"role": "user", "content": "go"}, {"role": "assistant", "content": "no"}, {"role": "developer", "content": [{"text": "<env> MARK"}, {"text": 5}, "loose", {"other": 1}]},
            7, {"role": "system"}, {"role": "user", "content": 3}, {"role": 1, "content": "x"}, {"role": "system", "content": ""},
        ],
    }
    rows = [(1, json.dumps(good)), (2, "{broken"), (3, None), (4, '{"instructions": 5, "input": {"role": "user"}}'), (5, "[]"), (6, '{"input": []}')]
    df = spark.createDataFrame(rows, "id int, request string")
    out = requests.instruction_blocks(df, "id", "request", {"fixture:m": "MARK", "client:env": "<env>"}, {"probe:go": "go"}, root="/tmp/x")
    got = {r.location: r for r in out.collect()}
    assert {(r.id, at, r.role, tuple(r.origins)) for at, r in got.items()} == {
        (1, "$.instructions", "system", (requests.UNKNOWN,)), (1, "$.input[0].content", "user", ("probe:go",)),
        (1, "$.input[2].content[0]", "developer", ("fixture:m", "client:env")), (1, "$.input[7].content", "system", (requests.UNKNOWN,)),
    }
    own = got["$.instructions"]
    assert own.bytes == 14 and own.sha256 == hashlib.sha256(b"base at /tmp/x").hexdigest() and own.normalized_sha256 == hashlib.sha256(b"base at <fixture>").hexdigest()


def test_lines_of_strings(spark):
    from corpusmill.operators import evaluate

    texts = ["", "a", "a\n", "a\r\nb", "a\rb\r", "\n\n", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a\x85b", "a b ", "a\x1fb\tc", "é\r\n\r"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", evaluate.string_lines("t").alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(t.splitlines()) for i, t in enumerate(texts)}
