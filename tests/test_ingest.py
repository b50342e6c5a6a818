import datetime as dt
import json
import os

import pytest

from quarry.operators import evaluation, sessions
from quarry.plans import ingest, measure, retrieve, scratch, serve
from quarry.settings import Settings
from quarry.sources import index, store
from quarry.streaming import progress


def _tree(root, names):
    for name, text in names.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_ingest_and_ask(spark, tmp_path):
    settings = Settings(data_dir=str(tmp_path / "data"))
    body = "\n    value = check(user, password)\n    return value\n"
    one = _tree(tmp_path / "one", {"auth.py": "import utils.text\n\n\ndef login(user, password):" + body, "utils/text.py": "def clean(text, extra):" + body, "a.txt": "no"})
    two = _tree(tmp_path / "two", {"main.py": "def start(user, password):" + body})
    job = ingest.ingest(spark, one, "p1", settings, "job1")
    ingest.ingest(spark, two, "p2", settings)
    assert [r.stage for r in progress.read(spark, settings.table("progress"), job).collect()] == ["loading", "chunking", "embedding", "saving", "graph", "done"]
    made = ingest.load(spark, "p1", settings)
    assert sorted((r.chunk_id, r.name) for r in made.chunks.collect()) == [(0, "login"), (1, "clean")]
    assert [(r.src, r.dst) for r in made.edges.collect()] == [("auth.py", "utils/text.py")]
    asked = spark.createDataFrame([(1, "login password", [float(x) for x in index.hashed(["login password"])[0]])], "query_id long, query string, embedding array<float>")
    messages = retrieve.prompts(made, asked).collect()[0].messages
    assert "def login" in messages[-1].content
    ingest.ingest(spark, two, "p1", settings)  # replaces the project, leaves the other
    assert [r.name for r in ingest.load(spark, "p1", settings).chunks.collect()] == ["start"] and ingest.load(spark, "p2", settings) is not None
    (tmp_path / "empty").mkdir()
    with pytest.raises(ingest.EmptySource):
        ingest.ingest(spark, _tree(tmp_path / "empty", {"x.txt": "no"}), "p1", settings, "bad")
    assert progress.read(spark, settings.table("progress"), "bad").collect()[-1].pct == -1
    assert ingest.load(spark, "p1", settings) is not None and ingest.load(spark, "nope", settings) is None
    assert ingest.load(spark, "p1", Settings(data_dir=str(tmp_path / "nowhere"))) is None


def test_follow_up_is_searched_by_its_own_vector(spark, tmp_path):
    settings = Settings(data_dir=str(tmp_path / "data"), rerank_keep=5)
    one = _tree(tmp_path / "one", {f"f{n}.py": f"def part_{w}(value, extra):\n    {w} = check(value, extra)\n    return {w}\n" for n, w in enumerate("login upload parser router".split())})
    ingest.ingest(spark, one, "p", settings)
    made = ingest.load(spark, "p", settings)
    asked = spark.createDataFrame([(1, "why?", [float(x) for x in index.hashed(["why?"])[0]])], "query_id long, query string, embedding array<float>")
    past = spark.createDataFrame([(1, 0, "user", "how does part_login check value extra")], "query_id long, pos long, role string, content string")
    new = retrieve.rewritten(made, asked, past).collect()[0]
    assert new.query == "how does part_login check value extra why?"
    assert new.embedding == pytest.approx(index.hashed([new.query])[0].tolist())
    hits = retrieve.search(made, retrieve.rewritten(made, asked, past), keywords=False, settings=Settings(vector_cut=3.0)).orderBy("rank").collect()
    first = made.chunks.where(f"chunk_id = {hits[0].chunk_id}").collect()[0]
    assert first.name == "part_login"
    silent = retrieve.Index(made.chunks, made.vectors, made.words)
    assert retrieve.rewritten(silent, asked, past).collect()[0].embedding is None
    assert retrieve.rewritten(silent, asked, past.limit(0)).collect()[0].embedding is not None
    top = retrieve.retrieve(made, asked, past, settings=Settings(rerank_keep=1, graph_chunks=0)).collect()
    assert len(top) == 1


def test_index_store(spark, tmp_path):
    settings = Settings(data_dir=str(tmp_path / "data"), public=True, rate_limit=1, query_cache=1, embedding_cache=1, history_turns=1)
    held = serve.IndexStore(spark, settings)
    assert not held.ready() and not held.switch("p")
    tree = _tree(tmp_path / "one", {"a.py": "def login(user, password):\n    return check(user, password, user)\n"})
    held.ingest(tree, "p")
    assert held.ready() and held.project_id == "p"
    first = held.index
    assert not held.switch("none") and held.index is first and held.project_id == "p"
    held.ingest(_tree(tmp_path / "two", {"b.py": "def upload(user, password):\n    return check(user, password, user)\n"}), "q")
    assert held.project_id == "q" and held.switch("p") and held.index is first
    with pytest.raises(ingest.EmptySource):
        held.ingest(_tree(tmp_path / "three", {"x.txt": "no"}), "q")
    assert held.project_id == "p"
    now = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "c", now, "s", "k"), (2, "c", now, "s", "j"), (3, "d", now, "s", "k"), (4, None, now, "s", "k")], "event_id long, client string, ts timestamp, scope string, key string")
    assert {r.event_id: r.allowed for r in serve.admitted(log, settings).collect()} == {1: True, 2: False, 3: True, 4: False}
    assert all(r.allowed for r in serve.admitted(log, Settings()).collect())
    assert {r.event_id: r.hit for r in serve.query_hits(log, settings, "scope", "key").collect()} == {1: False, 2: False, 3: False, 4: True}
    assert [r.event_id for r in serve.embedding_hits(log, Settings(), "scope", "key").where("hit").orderBy("event_id").collect()] == [3, 4]
    rows = spark.createDataFrame([("a", "o"), ("b", None)], "id string, owner_id string")
    assert [r.id for r in serve.visible(rows, "o", settings).collect()] == ["a"] and serve.visible(rows, None, settings).count() == 0 and serve.visible(rows, None, Settings()).count() == 2
    turns = spark.createDataFrame([(1, "s", "user", "q", now), (2, "s", "assistant", "r", now)], "id long, session_id string, role string, content string, created_at timestamp")
    assert [r.id for r in serve.history(turns, settings).collect()] == [2]


def test_measured_runs(spark, tmp_path):
    settings = Settings(data_dir=str(tmp_path / "data"))
    ingest.ingest(spark, _tree(tmp_path / "one", {"auth.py": "def login(user, password):\n    return check(user, password, user)\n"}), "p", settings)
    made = ingest.load(spark, "p", settings)
    asked = evaluation.built_in(spark)
    asked = asked.join(made.embed(asked), "query_id")
    runs = {name: measure.evaluate(made, asked, words) for name, words in (("vector_only", False), ("hybrid", True))}
    got = json.loads(measure.document(runs).collect()[0].json)
    assert set(got) == {"vector_only", "hybrid"} and len(got["hybrid"]["query_details"]) == 8
    report = got["hybrid"]
    assert report["queries"] == 8 and report["mean_latency_ms"] > 0 and report["timestamp"].endswith("Z") and report["p_at_1"] == 0.25
    assert report["query_details"][0]["retrieved_files"] == ["auth.py"] and report["query_details"][0]["latency_ms"] > 0


def test_scope_deletes_what_was_written(spark):
    with scratch.scope(spark):
        rows = scratch.written(spark.range(3))
        path = rows.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path.removeprefix("//"))
    assert not os.path.exists(path.removeprefix("//"))


def test_store(spark, tmp_path):
    path = str(tmp_path / "sessions")
    store.create(spark, path, sessions.SESSIONS)
    store.create(spark, path, sessions.SESSIONS)
    now = dt.datetime(2024, 1, 1)
    row = spark.createDataFrame([("New Chat", now, now)], "title string, created_at timestamp, updated_at timestamp")
    store.insert(store.with_ids(row), path, sessions.SESSIONS)
    got = store.read(spark, path, sessions.SESSIONS).collect()
    assert len(got) == 1 and len(got[0].id) == 36 and got[0].owner_id is None
    with pytest.raises(Exception, match="title must not be null"):
        store.insert(store.with_ids(row.drop("title")), path, sessions.SESSIONS)
    assert store.read(spark, path, sessions.SESSIONS).count() == 1


def test_report_sink(spark, tmp_path):
    scores = spark.createDataFrame([(0, 1.0, 0.3, 0.2, 0.5, 1)], "query_id long, p_at_1 double, p_at_3 double, p_at_5 double, reciprocal_rank double, results long")
    both = evaluation.compare({"vector_only": evaluation.report(scores), "hybrid": evaluation.report(scores)})
    store.write_report(both, str(tmp_path / "report"))
    assert {r.run: r.mrr for r in spark.read.json(str(tmp_path / "report")).collect()} == {"vector_only": 0.5, "hybrid": 0.5}
    assert store.report_json(both).collect()[0].json.startswith('{"queries":1,"p_at_1":1.0')


def test_settings():
    assert Settings().rate_limit == 10 and Settings().query_ttl == 300.0
    made = Settings.from_env({"QUARRY_RATE_LIMIT": "3", "QUARRY_PUBLIC": "true", "QUARRY_DATA_DIR": "/d/"})
    assert (made.rate_limit, made.public, made.table("chunks")) == (3, True, "/d/chunks")
    with pytest.raises(ValueError):
        Settings.from_env({"QUARRY_FINAL_K": "many"})
