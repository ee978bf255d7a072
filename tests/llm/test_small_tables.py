"""Sharding, license scan, line dedup, decontamination and top-k on small hand-made tables, and
every oracle query against DuckDB."""

import math
import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, licenses, line_dedup, queries, sharding, topk
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string"


def cell(x):
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, int | float) or hasattr(x, "dtype") and x.dtype.kind in "fiu":
        return round(float(x), 5)
    return str(x)


def rows(frame):
    return sorted((tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).fetch_df())


# sharding


def sizes(out):
    found = {}
    for r in out:
        found.setdefault(r.shard, []).append(r.n_bytes)
    return found


def test_shards_fit(spark):
    docs = table(spark, SF, "documents")
    for limit in (20_000, 3_000, 200):
        out = sharding.assign_shards(docs, limit).collect()
        assert len(out) == docs.count()
        for shard, n in sizes(out).items():
            assert sum(n) <= limit or len(n) == 1, shard
        assert all(r.oversized == (r.n_bytes > limit) and len(r.shard) == r.depth for r in out)


def test_shard_splits_only_what_is_too_large(spark):
    out = sharding.assign_shards(table(spark, SF, "documents"), 20_000).collect()
    by_prefix = {}
    for r in out:
        for d in range(r.depth):
            by_prefix[r.shard[:d]] = by_prefix.get(r.shard[:d], 0) + r.n_bytes
    assert all(n > 20_000 for n in by_prefix.values())


def test_shard_edges(spark):
    one = [(7, "x" * 40, None)] * 100 + [(1, None, None), (2, "", None), (None, "n" * 500, None), (3, "y" * 300, None)]
    out = sharding.assign_shards(spark.createDataFrame(one, DOCS).repartition(3), 100).collect()
    assert len(out) == len(one)
    for shard, n in sizes(out).items():
        assert sum(n) <= 100 or len(n) == 1, (shard, n)
    assert sum(r.oversized for r in out) == 2
    assert sharding.assign_shards(spark.createDataFrame([], DOCS), 100).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i % 20 if i % 7 else None, "z" * i, None) for i in range(50)], DOCS)
    sharding.write_shards(docs, str(tmp_path / "out"), 200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(len(r.text) for r in back.collect()) == list(range(50))
    assert all(r.n <= 200 for r in back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).collect())


# license scan


def plain_hits(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_licenses(spark):
    texts = [None, "", "Under the MIT license under the mit License", "x Apache License, Version 2.0 y apache-license version 2", "cc by nc CC BY-NC 4.0", "mit license under the", "Éüß 12 a_b", "word " * 20_000 + "licensed under the GNU General Public License, version 3", "under the mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(2, texts[2], "again")], DOCS)
    for r in licenses.scan_licenses(df).collect():
        n, base = plain_hits(texts[r.doc_id])
        assert r.n_words == n
        assert sorted((h.start, h.label) for h in r.hits if h.base) == base
        assert all(0 <= h.score <= 1 for h in r.hits)
    labels = {r.doc_id: {h.label for h in r.hits} for r in licenses.scan_licenses(df).collect()}
    assert labels[7] == {"gpl-3"} and labels[9] == {"mit"} and not labels[5] and not labels[8]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


# line dedup

A = "the first passage has more than six words in it."
B = "another line which is long enough to count here"


def test_lines(spark):
    texts = {1: f"{A}\nown line of the first document only", 2: f"own start of two is here now\n{A.upper()}\nx", 3: f"some words before it come first. {A} {B}", 4: f"{B}\n{B}", 5: None, 6: "", 7: "short line\nshort line"}
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], DOCS)
    found = {r.doc_id: [(s.start, s.end, s.first_id) for s in r.removed] for r in line_dedup.find_repeats(df).collect()}
    assert [texts[2][a:b] for a, b, _ in found[2]] == [A.upper()] and found[2][0][2] == 1
    assert [texts[3][a:b] for a, b, _ in found[3]] == [A]
    assert len(found[4]) == 2 and found[4][0][2] == 3
    assert found[1] == found[5] == found[6] == found[7] == []
    cut = {r.doc_id: r.text for r in line_dedup.dedup_texts(df).collect()}
    assert cut[1] == texts[1] and cut[5] is None and A.upper() not in cut[2] and cut[4].strip() == ""
    assert line_dedup.find_repeats(df.limit(0)).count() == 0


def test_lines_brute_force(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first, want = {}, {}
    for i in sorted(texts):
        for a, b, d in line_dedup.units(texts[i]):
            if d in first:
                want.setdefault(i, []).append((a, b, first[d]))
            else:
                first[d] = i
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in line_dedup.find_repeats(docs).collect() if r.removed}
    assert got == want


def test_short_units_of_a_repeated_passage(spark):
    short = "Yes! No.\n- milk\n- two eggs\nWell then.\n\nGo home!! Now!!"
    mixed = f"Oh. {A} So it is."
    texts = {1: f"{short}\n{mixed}", 2: f"Quite another beginning. Here:\n{short}\nand an end", 3: f"Hm. {mixed} Fine.", 4: "Spam! " * 40, 5: "Ham! " * 8, 6: "Ham! " * 8, 7: "Yes! No.\n- milk"}
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], DOCS)
    cut = {r.doc_id: r.text.split() for r in line_dedup.dedup_texts(df).collect()}
    assert cut[1] == texts[1].split() and cut[5] == texts[5].split() and cut[7] == texts[7].split()
    assert cut[2] == "Quite another beginning. Here: and an end".split()
    assert cut[3] == ["Hm.", "Fine."]
    assert cut[4] == ["Spam!"] * 6 and cut[6] == []


def test_every_repeated_run_is_covered():
    import random

    rng = random.Random(5)
    for _ in range(300):
        run = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((1, 1, 2, 3, 5, 6, 9)))) for _ in range(rng.randrange(1, 9))]
        if sum(len(u.split()) for u in run) < line_dedup.MIN_WORDS:
            continue
        passage = "\n".join(run)
        around = [f"{i} before\n{passage}\n{i} after {i}" for i in range(2)]
        first = {d for _, _, d in line_dedup.units(around[0])}
        spans = [(a, b) for a, b, d in line_dedup.units(around[1]) if d in first]
        assert line_dedup.cut(around[1], spans).split() == "1 before 1 after 1".split()


def test_lines_of_named_documents(spark):
    df = spark.createDataFrame([("a", A, "x"), ("b", A, "x"), ("c", B, "x")], "doc_id string, text string, removed string")
    found = {r.doc_id: [s.first_id for s in r.removed] for r in line_dedup.find_repeats(df).collect()}
    assert found == {"a": [], "b": ["a"], "c": []}
    assert {r.doc_id: r.text for r in line_dedup.dedup_texts(df).collect()} == {"a": A, "b": "", "c": B}


def test_rank_decides(spark):
    df = spark.createDataFrame([(1, A, "b"), (2, A, "a"), (3, A, None)], DOCS)
    got = {r.doc_id: len(r.removed) for r in line_dedup.find_repeats(df, rank_col="n_words").collect()}
    assert got == {1: 1, 2: 0, 3: 1}


# decontamination


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    swapped = " ".join("other" if i in (5, 12) else w for i, w in enumerate(words))
    texts = {1: f"start {item} end", 2: f"x y {swapped.upper()}!", 3: "nothing of the kind " * 10, 4: " ".join(words[:9]), 5: None, 6: "", 7: " ".join(reversed(words)), 8: "pad " * 30_000 + item, 9: " ".join(words[:17])}
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()] + [(1, texts[1], "again")], DOCS)
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id long, text string")
    for most in (decontam.MOST_HASHES, 0):  # broadcast, and the join for large benchmarks
        got = {r.doc_id: (r.item_id, r.matched, r.start) for r in decontam.contaminated(docs, bench, most_hashes=most).collect()}
        assert got == {1: (10, 20, 1), 2: (10, 18, 2), 8: (10, 20, 30_000), 9: (10, 17, 0)}
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [3, 4, 5, 6, 7]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_count_whole(spark):
    docs = spark.createDataFrame([(1, "So: what is THE capital of france? Paris", "c"), (2, "what is the capital", "c"), (3, "Two plus two", "c"), (4, "of", "c"), (5, "two plus three " * 50, "c")], DOCS)
    bench = spark.createDataFrame([(1, "What is the capital of France"), (2, "two plus two"), (3, "of"), (4, ""), (2, "plus three two")], "item_id long, text string")
    for most in (decontam.MOST_HASHES, 0):
        got = sorted((r.doc_id, r.item_id, r.matched) for r in decontam.contaminated(docs, bench, most_hashes=most).collect())
        assert got == [(1, 1, 6), (3, 2, 3), (5, 2, 3)]
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, least_words=1).collect())
    assert got == [(1, 1), (1, 3), (2, 3)][:2] + [(3, 2), (4, 3), (5, 2)]
    con = duckdb.connect()
    con.register("d", docs.toPandas())
    con.register("b", bench.toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM d")
    con.execute("CREATE VIEW benchmark AS SELECT * FROM b WHERE text <> 'plus three two'")
    assert rows(con.execute(decontam.contaminated_sql()).fetch_df()) == rows(decontam.contaminated(docs, bench.where("text <> 'plus three two'")).toPandas())


def test_share_of_accepted_patterns_that_hit():
    """The docstring's figures: substitution patterns of one stretch that leave some window whole."""
    from itertools import combinations

    def share(words, changed):
        hit = total = 0
        for out in combinations(range(words), changed):
            total += 1
            hit += any(not {i + p for p in m} & set(out) for m in decontam.MASKS for i in range(words - decontam.SPAN + 1))
        return hit / total

    assert share(16, 3) >= 0.97 and share(15, 3) >= 0.92 and share(12, 2) >= 0.84
    assert all(share(n, k) == 1 for n, k in ((16, 1), (20, 1)))
    assert 0.26 < share(10, 2) < 0.28


def test_item_without_id(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    docs = spark.createDataFrame([(1, f"so {item}", "c"), (2, "nothing of the kind " * 10, "c")], DOCS)
    bench = spark.createDataFrame([(None, item), (3, "other " * 20)], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.start) for r in got] == [(1, None, 20, 1)]
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [2]


def test_rows_that_share_an_id_leave_on_their_own(spark):
    from tidemark.llm import jaccard_join, toxicity

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    clean = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcd"]
    docs = spark.createDataFrame([(None, item, "c"), (None, clean[0], "c"), (5, item, "c"), (5, clean[1], "c"), (None, None, "c")], DOCS)
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    left = decontam.decontaminate(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted([("None", clean[0]), ("5", clean[1]), ("None", "None")])

    same = [(None, clean[0]), (None, clean[1]), (None, clean[2]), (1, clean[2]), (7, clean[1]), (7, clean[3]), (7, clean[3]), (8, clean[3])]
    docs = spark.createDataFrame([(i, x, "c") for i, x in same], DOCS)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", clean[0]), ("1", clean[2]), ("7", clean[1]), ("7", clean[3])])

    good = [f"a quiet walk along river number {i}" for i in range(40)]
    bad = [f"zorg zorg blarg number {i}" for i in range(40)]
    rows_ = [(i, x, "c") for i, x in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows_, (None, "zorg zorg blarg", "c"), (None, "a quiet walk", "c"), (500, "zorg zorg blarg", "c"), (500, "a quiet walk", "c")], DOCS)
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int")
    left = toxicity.reject_toxic(docs, labels).collect()
    assert sorted((str(r.doc_id), r.text) for r in left if r.doc_id is None or r.doc_id == 500) == [("500", "a quiet walk"), ("None", "a quiet walk")]


# top-k


def best_of(rows_, step=100, k=10):
    """Every row's score against every query row but itself, by plain integers."""
    ok = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows_) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, q, qv in ok:
        if q is not None and q % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0, m) for m, i, v in ok if m != n)
            want += [(q, at + 1, None if none else i, -s) for at, (s, none, i, _) in enumerate(scored[:k])]
    return sorted(want, key=str)


def test_topk_edges(spark):
    inf = float("inf")
    rows_ = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [inf, 1.0]), (100, [0.25]), (6, []), (None, [1.0, 1.0]), (7, [float("nan"), 1.0]), (1, [2.0, 2.0]), (100, [3.0, -1.0]), (100, [3.0, -1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows_], "vec_id long, embedding array<float>, score int")
    for k in (10, 1):
        assert sorted((tuple(r) for r in topk.top_k(df, k=k).collect()), key=str) == best_of(rows_, k=k)
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_outliers_and_low_scores(spark):
    import random

    rng = random.Random(3)
    rows_ = [(i % 250, [float(rng.choice((-1, 1)) * rng.randrange(4)) for _ in range(8)]) for i in range(400)]
    rows_ += [(401, [200_000.0] * 8), (500, [-3e5] * 8), (600, [4e9] * 8), (601, [-4e9, 4e9] * 4), (602, [5e11] * 8), (None, [1e9] * 8)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    top = (1 << 63) - 1
    want = [(q, n, i, max(-top - 1, min(top, s))) for q, n, i, s in best_of(rows_)]
    got = [tuple(r) for r in topk.top_k(df, query_block=3, chunk_rows=64).collect()]
    saturated = lambda found: sorted(((q, s) for q, _, _, s in found), key=str)
    assert saturated(got) == saturated(want)
    exact = lambda found: sorted((r for r in found if abs(r[3]) < top), key=str)
    assert exact(got) == exact(want)
    below = [(i, [-1.0 - i / 7, -2.0]) for i in range(1, 60)] + [(100, [1.0, 3.0])]
    df = spark.createDataFrame(below, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in topk.top_k(df).collect()), key=str) == best_of(below)


def test_topk_many_ties(spark):
    df = spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("embedding"))
    got = topk.top_k(df, query_block=2, chunk_rows=50).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {0, 100, 200, 300, 400, 500}
    for q, found in by.items():
        want = sorted((-1024 * 1024, i) for i in range(600) if i != q)[:10]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
