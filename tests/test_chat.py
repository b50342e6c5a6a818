import datetime as dt

import pytest

from quarry.operators import prompt, sessions
from quarry.plans import retrieve
from quarry.operators import bm25
from quarry.queries import QUERIES


def _t(n):
    return dt.datetime(2024, 1, 1, 0, 0, n)


@pytest.mark.parametrize(
    ("history", "query", "expected"),
    [
        ([], "why?", "why?"),
        ([("user", "how does the login work"), ("assistant", "so")], "and why", "how does the login work and why"),
        ([("user", "how does the login work"), ("user", "short one")], "why", "how does the login work why"),
        ([("user", "short one")], " why ", "short one why"),
        ([("user", "how does the login work")], "a much longer question", "a much longer question"),
        ([("assistant", "only an answer of words")], "why", "why"),
        ([("user", "   ")], "why", "    why"),
    ],
)
def test_rewrite(spark, history, query, expected):
    turns = spark.createDataFrame([(1, n, r, c) for n, (r, c) in enumerate(history)], "query_id long, pos long, role string, content string")
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    assert prompt.rewrite(turns, asked).collect()[0].rewritten == expected


def test_context_and_messages(spark):
    schema = "query_id long, rank int, file_name string, name string, type string, start_line int, end_line int, content string"
    hits = spark.createDataFrame([(1, 1, "b.py", "b.py", "file", None, None, "y" * 1200), (1, 0, "a.py", "login", "FunctionDef", 1, 4, "def login")], schema)
    made = prompt.context(hits).collect()[0].context
    assert made == "--- FILE: a.py (lines 1-4) | FunctionDef: login ---\ndef login\n\n---\n\n--- FILE: b.py ---\n" + "y" * 1000
    queries = spark.createDataFrame([(1, "why?"), (2, "no hits")], "query_id long, query string")
    history = spark.createDataFrame([(1, n, "user" if n % 2 == 0 else "assistant", f"t{n}") for n in range(20)], "query_id long, pos long, role string, content string")
    got = {r.query_id: r.messages for r in prompt.messages(queries, prompt.context(hits), history).collect()}
    assert [m.content for m in got[1][1:-1]] == [f"t{n}" for n in range(14, 20)]
    assert got[1][0].role == "system" and got[1][-1].content.endswith("Question: why?") and len(got[2]) == 2
    shown = {r["rank"]: (r.file, r.lines, r.name, r.via) for r in prompt.sources(hits).collect()}
    assert shown == {0: ("a.py", "1-4", "login", None), 1: ("b.py", "?-?", "b.py", None)}
    assert prompt.context(hits.limit(0)).count() == 0


def _sessions(spark):
    rows = [("s1", "a", "p1", "o1", _t(1), _t(1)), ("s1", "b", "p1", "o1", _t(1), _t(5)), ("s2", "c", "p2", None, _t(2), _t(2)), (None, "x", None, None, _t(1), _t(1))]
    return spark.createDataFrame(rows, "id string, title string, project_id string, owner_id string, created_at timestamp, updated_at timestamp")


def test_sessions(spark):
    rows = sessions.latest(_sessions(spark))
    assert {(r.id, r.title) for r in rows.collect()} == {("s1", "b"), ("s2", "c")}
    assert [r.id for r in sessions.listed(rows).collect()] == ["s1", "s2"]
    assert [r.id for r in sessions.listed(rows, "o1", public=True).collect()] == ["s1"]
    assert sessions.listed(rows, None, public=True).count() == 0
    assert rows.where(sessions.owned("o1", True)).count() == 1 and rows.where(sessions.owned("o1", False)).count() == 2
    assert sessions.migrate(rows.drop("owner_id")).columns[-1] == "owner_id"
    messages = spark.createDataFrame([(1, "s1", "user", "m", _t(9)), (2, "s2", "user", "n", _t(1)), (3, None, "user", "n", _t(1))], "id long, session_id string, role string, content string, created_at timestamp")
    assert {r.id: r.updated_at.second for r in sessions.touch(rows, messages).collect()} == {"s1": 9, "s2": 2}
    left, kept = sessions.delete_sessions(rows, messages, rows.where("id = 's1'"))
    assert [r.id for r in left.collect()] == ["s2"] and sorted(r.id for r in kept.collect()) == [2, 3]
    projects = spark.createDataFrame([("p1", 1), ("p2", 2)], "id string, files_count int")
    left, freed = sessions.delete_projects(projects, rows, projects.where("id = 'p1'"))
    assert {r.id: r.project_id for r in freed.collect()} == {"s1": None, "s2": "p2"} and left.count() == 1
    titled = sessions.retitle(rows, spark.createDataFrame([("s2", "new")], "id string, title string"))
    assert {r.id: r.title for r in titled.collect()} == {"s1": "b", "s2": "new"}


def test_project_stats(spark):
    projects = spark.createDataFrame([("p1", "n", 0, 0, _t(1)), ("p2", "m", 1, 1, _t(1))], "id string, name string, files_count long, chunks_count long, updated_at timestamp")
    stats = spark.createDataFrame([("p1", 10, 42, _t(3))], "id string, files_count long, chunks_count long, updated_at timestamp")
    got = {r.id: (r.files_count, r.chunks_count, r.updated_at.second) for r in sessions.update_stats(projects, stats).collect()}
    assert got == {"p1": (10, 42, 3), "p2": (1, 1, 1)}


def test_last_turns(spark):
    rows = [(n, "s", " User" if n % 2 == 0 else "ASSISTANT", f"m{n}", _t(n // 2), _t(0)) for n in range(10)] + [(50, "s", "system", "no", _t(30), _t(0)), (9, "s", "assistant", "m9 again", _t(4), _t(9)), (60, "s", None, "no", None, _t(0))]
    messages = spark.createDataFrame(rows, "id long, session_id string, role string, content string, created_at timestamp, loaded_at timestamp")
    got = sessions.last_turns(sessions.once(messages), 3).orderBy("pos").collect()
    assert [(r.pos, r.id, r.content) for r in got] == [(0, 7, "m7"), (1, 8, "m8"), (2, 9, "m9 again")]


def test_title_is_the_first_question_of_long_sessions(spark, tmp_path):
    rows = [(n, "s", "user" if n % 2 == 0 else "assistant", f"m{n}", _t(n), _t(0)) for n in range(30)]
    rows += [(100 + n, "t", "User " if n == 1 else "assistant", f"t{n}", _t(n), _t(0)) for n in range(15)] + [(200, "u", "assistant", "no", _t(0), _t(0)), (201, "s", "user", "no time", None, _t(0))]
    messages = spark.createDataFrame(rows, "id long, session_id string, role string, content string, created_at timestamp, loaded_at timestamp")
    messages.write.parquet(str(tmp_path / "messages.parquet"))
    assert {r.session_id: r.title for r in QUERIES["auto_title"](spark, str(tmp_path)).collect()} == {"s": "m0", "t": "t1"}


def test_retrieve(spark):
    chunks = spark.createDataFrame(
        [(0, "p", "auth.py", "auth.py", "FunctionDef", "login", 1, 4, "def login(user, password)"), (1, "p", "users.py", "users.py", "ClassDef", "UserService", 1, 5, "class UserService"), (2, "p", "utils.py", "utils.py", "FunctionDef", "process_data", 1, 2, "def process_data")],
        "chunk_id long, project_id string, path string, file_name string, type string, name string, start_line int, end_line int, content string",
    )
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "chunk_id long, embedding array<float>")
    edges = spark.createDataFrame([("p", "auth.py", "utils.py")], "project_id string, src string, dst string")
    asked = spark.createDataFrame([(7, "login password", [1.0, 0.0])], "query_id long, query string, embedding array<float>")
    index = retrieve.Index(chunks, vectors, bm25.fit(chunks), edges)
    got = retrieve.retrieve(index, asked).orderBy("rank").collect()
    assert got[0].chunk_id == 0 and not any(r.is_graph for r in got)  # all three files are hits: nothing to add
    alone = retrieve.retrieve(index, asked, keywords=False).orderBy("rank").collect()
    assert [(r.chunk_id, r.is_graph) for r in alone] == [(0, False), (2, True)]
    messages = retrieve.prompts(index, asked).collect()[0].messages
    assert messages[-1].content.startswith("Use ONLY the provided code context") and "FILE: auth.py" in messages[-1].content
