import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.operators import bm25, evaluation, fusion, vector
from quarry.plans import keywords
from quarry.queries import QUERIES as REGISTERED


def plain_scores(texts, query):
    docs = [re.findall(r"[a-zA-Z_]\w*", (t or "").lower()) for t in texts]
    n, mean = len(docs), (sum(map(len, docs)) / len(docs) if docs else 1) or 1
    df = Counter(w for d in docs for w in set(d))
    out = []
    for d in docs:
        tf, total = Counter(d), 0.0
        for w in re.findall(r"[a-zA-Z_]\w*", query.lower()):
            if tf[w]:
                total += math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean))
        out.append(total)
    return out


TEXTS = ["def login(user, password): check password", "class UserService: get user", "def process_data(data)", "", None, "auth auth login", "lorem " * 300 + "login"]
QUERIES = ["login password", "user user service", "nothing here matches zzz", "", "auth"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "chunk_id long, content string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(n, q) for n, q in enumerate(QUERIES)], "query_id long, query string")


def test_bm25_ranks_as_a_plain_scorer(corpus, queries):
    found = bm25.ranked(bm25.fit(corpus), queries, 4).collect()
    for q, text in enumerate(QUERIES):
        plain = plain_scores(TEXTS, text)
        order = sorted(range(len(TEXTS)), key=lambda d: (-round(plain[d], 9), d))[:4]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r.chunk_id for r in mine] == order
        assert [r.score for r in mine] == pytest.approx([plain[d] for d in order], abs=1e-8)


def test_bm25_long_and_short(corpus, queries):
    plain = {(r.query_id, r.chunk_id): r.score for r in bm25.scores(bm25.fit(corpus), queries).collect()}
    assert plain[0, 0] / plain[0, 6] < 100


def test_empty_corpus(spark, queries):
    empty = bm25.fit(spark.createDataFrame([], "chunk_id long, content string"))
    assert empty.corpus.collect()[0].avg_dl == 1.0
    assert bm25.ranked(empty, queries).count() == 0


def ranked_lists(spark, lists):
    return [spark.createDataFrame([(0, c, r) for r, c in enumerate(x)], "query_id long, chunk_id long, rank long") for x in lists]


@pytest.mark.parametrize("lists", [([0, 1, 2], [2, 0, 1]), ([3, 1, 2], [3, 2, 1]), ([1, 2], [3, 4]), ([], [5]), ([7, 8, 9], [9, 8, 7])])
def test_rank_fusion(spark, lists):
    score, seen = {}, []
    for x in lists:
        for r, c in enumerate(x):
            score[c] = score.get(c, 0) + 1 / (61 + r)
            seen.append(c) if c not in seen else None
    expected = sorted(score, key=lambda c: (-round(score[c], 12), seen.index(c)))
    got = fusion.reciprocal_ranks(ranked_lists(spark, lists)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == expected


def test_nearest_with_dirty_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8)).astype("f4")
    rows = [(n, v.tolist()) for n, v in enumerate(x)] + [(100, None), (101, [1.0] * 5), (3, x[3].tolist()), (102, [float("nan")] * 8), (103, x[0].tolist())]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, x[0].tolist()), (1, x[7].tolist()), (2, None)], "query_id long, embedding array<float>")
    got = vector.nearest(df, asked, 5).collect()
    for q, n in ((0, 0), (1, 7)):
        d = {m: round(float(((x[n].astype("f8") - x[m].astype("f8")) ** 2).sum()), 9) for m in range(50)}
        d[103] = d[0]
        order = sorted(d, key=lambda m: (d[m], m))[:5]
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == order
    assert not [r for r in got if r.query_id == 2]
    assert vector.nearest(df.limit(0), asked, 5).count() == 0
    cut = vector.cut(vector.nearest(df, asked, 5), 1e-6, 1).collect()
    assert {(r.query_id, r.chunk_id) for r in cut} == {(0, 0), (1, 7)}


def test_crowds_of_repeated_ids_push_no_neighbour_out(spark):
    # Near ids stand there a hundred times each, with several vectors; far ones once.
    rows = [(n % 4, [1.0 + (n // 4) / 1000, 0.0]) for n in range(400)] + [(10 + n, [3.0 + n, 0.0]) for n in range(6)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = vector.nearest(df, asked, 6).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2, 3, 10, 11] and [r.d2 for r in got[:4]] == [0.0] * 4


def test_many_queries_go_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).round(1).astype("f4")
    df = spark.createDataFrame([(n % 280, v.tolist()) for n, v in enumerate(x)] + [(900, None), (901, [1.0])], "chunk_id long, embedding array<float>")
    asked = df.selectExpr("chunk_id as query_id", "embedding").dropDuplicates(["query_id"]).cache()
    plain = {(r.query_id, r["rank"]): (r.chunk_id, r.d2) for r in vector.nearest(df, asked, 5).collect()}
    monkeypatch.setattr(vector, "QUERIES_AT_ONCE", 10)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 40)
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.d2) for r in vector.nearest(df, asked, 5).collect()} == plain and len(plain) == 1401


def test_stored_index_ranks_as_a_fresh_one(spark, corpus, queries, tmp_path):
    place = str(tmp_path / "keywords")
    keywords.save(bm25.fit(corpus), place, "p")
    keywords.save(bm25.fit(corpus.where("chunk_id < 2")), place, "q")
    stored = keywords.load(spark, place, "p")
    key = lambda rows: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in rows)
    assert key(bm25.ranked(stored, queries, 4).collect()) == key(bm25.ranked(bm25.fit(corpus), queries, 4).collect())
    assert keywords.load(spark, place, "q").corpus.collect()[0].n == 2
    plan = bm25.scores(stored, queries)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() or "bucket" in plan  # only the folders of the asked terms are read


def test_table_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "chunks.parquet")
    spark.createDataFrame([(1, "alpha beta")], "chunk_id long, content string").write.parquet(path)
    assert keywords.of_table(spark.read.parquet(path)).corpus.collect()[0].n == 1
    spark.createDataFrame([(2, "gamma")], "chunk_id long, content string").write.mode("append").parquet(path)
    assert keywords.of_table(spark.read.parquet(path)).corpus.collect()[0].n == 2


def test_rerank(spark):
    rows = [(0, 0, "Login password", "nothing", 1), (0, 1, "Login password", "the LOGIN and password", 2), (0, 2, "Login password", "logins", 3), (0, 3, "Login password", None, 4), (1, 0, "", "x", 5)]
    df = spark.createDataFrame(rows, "query_id long, rank int, query string, content string, extra int")
    got = [(r.query_id, r["rank"], r.extra, r.overlap) for r in fusion.rerank(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 0, 2, 2), (0, 1, 3, 1), (0, 2, 1, 0), (1, 0, 5, 0)]


def test_hybrid_survives_random_vectors(spark, corpus, queries):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(n, rng.normal(size=384).tolist()) for n in range(7)], "chunk_id long, embedding array<float>")
    asked = queries.join(spark.createDataFrame([(n, rng.normal(size=384).tolist()) for n in range(5)], "query_id long, embedding array<float>"), "query_id")
    got = fusion.hybrid(bm25.fit(corpus), vectors, asked).where("query_id = 0").orderBy("rank").collect()
    plain = plain_scores(TEXTS, QUERIES[0])
    # Distances of random vectors are in the hundreds, so the cut leaves the keyword list alone.
    assert [r.chunk_id for r in got] == sorted(range(7), key=lambda d: (-round(plain[d], 9), d))[:5]
    assert got[0].rrf_score == round(1 / 61, 4)


HITS = [("auth.py", "login", "def login"), ("users.py", "UserService", "class UserService"), ("utils.py", "process_data", "x")]


@pytest.mark.parametrize(
    ("files", "names", "p1", "rr"),
    [(["auth.py"], [], 1.0, 1.0), ([], ["userservice"], 0.0, 0.5), (["utils"], None, 0.0, 1 / 3), (["none.py"], ["nope"], 0.0, 0.0), ([], [], 0.0, 0.0), (None, None, 0.0, 0.0)],
)
def test_precision_and_reciprocal_rank(spark, files, names, p1, rr):
    hits = spark.createDataFrame([(0, n, *h) for n, h in enumerate(HITS)], "query_id long, rank long, file_name string, name string, content string")
    queries = spark.createDataFrame([(0, files, names), (1, ["a"], [])], "query_id long, expected_files array<string>, expected_names array<string>")
    got = {r.query_id: r for r in evaluation.per_query(hits, queries).collect()}
    assert got[0].p_at_1 == p1 and got[0].reciprocal_rank == pytest.approx(rr)
    assert got[0].p_at_5 == pytest.approx((rr > 0) / 5)
    assert (got[1].p_at_1, got[1].reciprocal_rank, got[1].results) == (0.0, 0.0, 0)
    assert got[0].retrieved_files == [h[0] for h in HITS] and got[0].retrieved_names == [h[1] for h in HITS] and got[1].retrieved_files == []
    report = evaluation.report(evaluation.per_query(hits, queries)).collect()[0]
    assert report.queries == 2 and report.mrr == pytest.approx(round(rr / 2, 4))


def test_built_in_set(spark):
    rows = evaluation.built_in(spark).collect()
    assert len(rows) == 8 and sum(not r.expected_files and not r.expected_names for r in rows) == 1
    both = evaluation.compare({"a": evaluation.report(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.5, 1)], "query_id long, p_at_1 double, p_at_3 double, p_at_5 double, reciprocal_rank double, results long")), "b": evaluation.report(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1)], "query_id long, p_at_1 double, p_at_3 double, p_at_5 double, reciprocal_rank double, results long"))}).collect()
    assert [(r.run, r.mrr_delta) for r in both] == [("a", 0.0), ("b", 0.5)]


def test_search_and_graph_start_from_whole_tables(spark, tmp_path):
    vectors = spark.createDataFrame([(n, [float(n), 1.0], n % 3) for n in range(30)], "vec_id long, embedding array<float>, label int")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = REGISTERED["embeddings_topk"](spark, str(tmp_path)).collect()
    assert len(found) == 300 and {r.query_id for r in found} == set(range(30))
    spark.createDataFrame([(n,) for n in range(15)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(n, n // 3) for n in range(15)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {(r.path, r.steps): r.nodes for r in REGISTERED["graph_bfs"](spark, str(tmp_path)).collect()}
    assert found == {(f"s{n}", steps): steps for n in range(15) for steps in (1, 2)}
