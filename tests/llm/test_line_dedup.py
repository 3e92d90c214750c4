import random
from collections import Counter, defaultdict

from zetamill.llm.line_dedup import dedup_lines


def brute(rows, ratio, min_pages):
    pages, seen = Counter(), defaultdict(Counter)
    for _, text, host in rows:
        if host is not None:
            pages[host] += 1
            seen[host].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    out = []
    for i, text, host in rows:
        lines = [] if text is None else text.split("\n")
        bad = {x for x, n in seen[host].items() if n >= min_pages and n > ratio * pages[host]} if host is not None else set()
        kept = [x for x in lines if x.strip(" ") not in bad]
        out.append((i, None if text is None else "\n".join(kept), sum(x.strip(" ") != "" for x in lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["", "head", " head ", "foot", f"own {i}", f"own {i % 7}", "é"]) for _ in range(rng.randint(0, 9))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(200)]
    rows += [(200, None, "a"), (201, "head\n" * 5000, "b"), (202, "\n\n", "c"), (None, "head", "a"), rows[0], (203, "head", "lonely")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as lines", "2 as host").repartition(3)
    for ratio, least in ((0.08, 3), (0.4, 3), (0.0, 1), (1.0, 1)):
        got = [(r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in dedup_lines(df, ratio=ratio, min_pages=least).collect()]
        assert sorted(got, key=str) == brute(rows, ratio, least)


def test_empty_and_order_of_columns(spark):
    df = spark.createDataFrame([], "n int, source string, doc_id long, text string")
    out = dedup_lines(df)
    assert out.count() == 0 and out.columns == ["n", "source", "doc_id", "text", "__n_lines", "__n_dropped"]


def test_a_dominant_group_of_copies_is_emptied(spark):
    rows = [(i, "same\ntext" if i < 10 else f"own {i}\nmore {i}", "a") for i in range(30)]
    got = [(r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted(got, key=str) == brute(rows, 0.08, 3)
    assert all(t == "" for i, t, _, _ in got if i < 10) and all(t == rows[i][1] for i, t, _, _ in got if i >= 10)


def test_columns_with_clashing_names(spark):
    rows = [(i, "head\nown", "a", "l", i, None) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __lines string, __n_lines int, __N_DROPPED string").selectExpr("*", "1 as __host", "2 as __kept")
    out = dedup_lines(df, ratio=0.5)
    assert out.columns == [*df.columns, "__n_lines_", "__n_dropped_"]
    assert all(r.text == "" and r["__n_lines_"] == 2 and r["__n_dropped_"] == 2 and r["__lines"] == "l" for r in out.collect())
