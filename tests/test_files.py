import ast
import os
import random

import pytest

from quarry.operators import chunking, graph, imports
from quarry.sources import files, index

PY = '''import os


@cached
def login(user, password):
    return check(user, password)


class UserService:
    """Users of the service."""

    def get_user(self, key):
        return self.users[key]

    async def drop(self, key):
        del self.users[key]


def tiny(): pass
LIMIT = 10
'''


def test_python_chunks():
    got = {c[2]: c for c in chunking.python_chunks(PY, "auth.py")}
    assert got["login"][1:] == ("FunctionDef", "login", 4, 6)
    assert got["UserService"][1] == "ClassDef" and got["UserService"][3:] == (9, 16)
    assert got["UserService.get_user"][1] == "FunctionDef" and got["UserService.drop"][1] == "AsyncFunctionDef"
    assert "tiny" not in got
    assert got["auth.py"][1] == "module" and got["auth.py"][0].splitlines() == ["import os", "def tiny(): pass", "LIMIT = 10"]
    assert chunking.python_chunks("def broken(:\n", "x.py") is None
    assert chunking.python_chunks("", "x.py") == [] and chunking.python_chunks("x = 1", "x.py") == []


JS = "import a from 'a';\n\nexport default function one() {\n  return 'a long enough body of text here';\n}\nconst two = () => {\n  return 'another long enough body of text';\n};\nlet z = 1;\n"


def _files(spark, rows):
    return spark.createDataFrame([("p", path, os.path.basename(path), content, n) for n, (path, content) in enumerate(rows)], "project_id string, path string, file_name string, content string, file_ord long")


def test_pattern_chunks_and_lines(spark):
    rows = [("a.JS", JS), ("b.go", "package x\n\nfunc A() int {\n\treturn 1 // with a long comment to pass fifty chars\n}\n"), ("c.html", "<p>" + "x" * 60), ("d.css", "tiny"), ("h.sh", "const a = 1 # a part of its own\nconst b = 2 # another part of its own"), ("e.py", "def broken(:\n" + "x" * 60), ("f.ts", None), ("g.rb", "")]
    got = sorted((r.path, r.start_line, r.end_line, r.type, r.name) for r in chunking.chunk_files(_files(spark, rows)).collect())
    assert got == [
        ("a.JS", 3, 5, "chunk", "one"),
        ("a.JS", 6, 8, "chunk", "two"),
        ("b.go", 3, 6, "chunk", "func A() int {"),
        ("c.html", 1, 1, "chunk", "<p>" + "x" * 37),
        ("e.py", 1, 2, "chunk", "broken"),
        ("h.sh", 1, 2, "file", "h.sh"),
    ]


@pytest.mark.parametrize(("line", "name"), [("def login(x):", "login"), ("  class User {", "User"), ("export const go = 1", "go"), ("struct P {", "P"), ("x" * 50, "x" * 40)])
def test_names(spark, line, name):
    df = spark.createDataFrame([(line + "\nrest",)], "c string")
    assert df.select(chunking.infer_name("c").alias("n")).collect()[0].n == name


def test_import_parsers(spark):
    rows = [
        ("a.py", "import os, a.b\nfrom x.y import z\nfrom . import q\ndef f():\n    import late\n"),
        ("b.py", "import a, b\nfrom c import (\n"),
        ("c.ts", "import x from './x';\nimport {\n y } from 'multi';\nimport('dyn'); require(\"req\");\nexport * from './re';\nimport 'bare';"),
        ("d.go", 'import (\n "fmt"\n "a/b"\n "strings"\n)\n'),
        ("e.rb", "require 'x'"),
        ("f.py", "x = 1"),
        ("g.py", None),
    ]
    got = {}
    for r in imports.file_imports(_files(spark, rows)).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append(r.module)
    assert got == {"a.py": ["os", "a.b", "x.y", "late"], "b.py": ["a", "c"], "c.ts": ["./x", "dyn", "req", "./re"], "d.go": ["fmt", "a/b"]}
    assert [n.module for n in ast.walk(ast.parse("from . import x")) if isinstance(n, ast.ImportFrom)] == [None]


GRAPH = [("src/main.py", "import auth\nimport utils.text\nimport main"), ("src/oauth.py", "x = 1"), ("src/auth.py", "import utils.text"), ("src/utils/text.py", ""), ("web/app.js", "import a from './lib';\nimport b from '../src/nope';\nimport c from './app';"), ("web/lib/index.js", ""), ("go/x.go", '"a/b"')]


def test_graph(spark):
    rows = _files(spark, GRAPH)
    all_imports, edges = graph.build(rows)
    got = {(r.src, r.dst) for r in edges.collect()}
    # `auth` meets oauth.py first (no boundary is asked for); unknown script imports fall on the index file; no edge to itself.
    assert got == {("src/main.py", "src/oauth.py"), ("src/main.py", "src/utils/text.py"), ("src/auth.py", "src/utils/text.py"), ("web/app.js", "web/lib/index.js")}
    starts = spark.createDataFrame([("p", "src/main.py")], "project_id string, path string")
    near = {(r.related, r.steps) for r in graph.related(edges, starts, 2).collect()}
    assert near == {("src/oauth.py", 1), ("src/utils/text.py", 1), ("src/auth.py", 2)}
    node = {r.path: r for r in graph.export(rows, all_imports, edges).collect()}
    assert node["src/utils/text.py"].dependents == ["src/auth.py", "src/main.py"] and node["go/x.go"].imports == ["a/b"] and node["go/x.go"].dependencies == []
    total = graph.totals(rows, edges).collect()[0]
    assert (total.total_files, total.total_edges) == (7, 4)
    assert graph.build(rows.limit(0))[1].count() == 0


def test_two_steps(spark, monkeypatch):
    # Counted without listing: the same numbers as the steps of `related`, whatever the keys, the blocks and what is sorted at a time.
    rng = random.Random(4)
    for keys, most in (([-(2**63), -1, 0, 2**63 - 1, *range(30)], 2**25), (list(range(70_000, 70_090)), 40), ([5], 1)):
        monkeypatch.setattr(graph, "BLOCK_NODES", most)
        monkeypatch.setattr(graph, "REACHED_NODES", max(2, most // 8))
        edges = [(rng.choice(keys), rng.randrange(25)) for _ in range(150)] + [(None, 1), (keys[0], None)]
        got = {(r.left, r.steps): r.nodes for r in graph.two_steps(spark.createDataFrame(edges, "left long, right long").repartition(3)).collect()}
        rights, lefts, want = {}, {}, {}
        for a, b in edges[:-2]:
            rights.setdefault(a, set()).add(b), lefts.setdefault(b, set()).add(a)
        for a, held in rights.items():
            want |= {(a, 1): len(held)} | ({(a, 2): n} if (n := len(set().union(*(lefts[b] for b in held)) - {a})) else {})
        assert got == want
    assert graph.two_steps(spark.createDataFrame([], "left long, right long")).count() == 0


def test_bfs_lists_no_pairs(spark, tmp_path):
    # 300 suppliers of the same 20 parts: 90,000 pairs, which no shuffle may hold.
    from quarry import queries

    spark.range(6000).selectExpr("id % 300 as l_suppkey", "id div 300 as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(300).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = queries.QUERIES["graph_bfs"](spark, str(tmp_path))
    assert {(r.path, r.steps, r.nodes) for r in found.collect()} == {(f"s{k}", *x) for k in range(300) for x in ((1, 20), (2, 299))}
    assert "related" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_graph_expansion(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "a", "c"), ("p", "a", "d")], "project_id string, src string, dst string")
    chunks = spark.createDataFrame([(5, "p", "b"), (4, "p", "b"), (3, "p", "c"), (2, "p", "d"), (1, "p", "a"), (0, "q", "b")], "chunk_id long, project_id string, path string")
    hits = spark.createDataFrame([(1, "p", "a"), (1, "p", "d"), (2, "p", "x")], "query_id long, project_id string, path string")
    assert [(r.query_id, r.chunk_id) for r in graph.expand(hits, chunks, edges).orderBy("rank").collect()] == [(1, 3), (1, 4)]


def test_scan(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / "auth.py").write_bytes(b"x = 1\r\ny = 2\r")
    (root / "pkg" / "util.py").write_text("z")
    (root / "pkg" / "BAD.py").write_bytes(b"\xff\xfe")
    (root / "UP.PY").write_text("no")
    (root / ".py").write_text("no")
    got = {r.path: (r.file_name, r.content) for r in files.scan(spark, str(root)).collect()}
    assert got == {"auth.py": ("auth.py", "x = 1\ny = 2\n"), "pkg/util.py": ("util.py", "z")}


def test_scan_of_a_root_below_its_own_name(spark, tmp_path, monkeypatch):
    root = tmp_path / "a b" / "src"
    (root / "lib" / "src").mkdir(parents=True)
    (root / "a.py").write_text("one")
    (root / "lib" / "src" / "a.py").write_text("two")
    (root / "Z.py").write_text("three")
    expected = [("Z.py", "three", 0), ("a.py", "one", 1), ("lib/src/a.py", "two", 2)]
    monkeypatch.chdir(root.parent)
    for place in (str(root), str(root) + "/", root.as_uri().replace("%20", " "), f"{root}/lib/.."):
        got = sorted((r.path, r.content, r.file_ord) for r in files.scan(spark, place).collect())
        assert got == expected, place


def test_first_file_wins_by_path(spark, tmp_path):
    for name in ("b/util.py", "a/util.py", "c/util.py"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text("x = 1")
    (tmp_path / "main.py").write_text("import util")
    found = files.scan(spark, str(tmp_path))
    assert [r.dst for r in graph.build(found)[1].collect()] == ["a/util.py"]


def test_hot_stems_and_ends(spark):
    # Every folder has an index file: each import meets one of them, not all.
    rows = _files(spark, [(f"web/p{n:02d}/index.js", "import a from 'nowhere/index'; import b from '../p07/index.js';") for n in range(40)])
    got = {(r.src, r.module): r.dst for r in graph.resolve(imports.file_imports(rows), rows).collect()}
    # A stem answers as well as an end, so the first index file is meant by both spellings.
    assert got == {(f"web/p{n:02d}/index.js", m): "web/p00/index.js" for n in range(40) for m in ("nowhere/index", "../p07/index.js")}


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "p", "a", "x", "f"), (1, "p", "a", "y", "g"), (2, "q", "b", "z", "")], "chunk_id long, project_id string, path string, content string, type string")
    vectors = index.embedded(chunks)
    assert {len(r.embedding) for r in vectors.collect()} == {384}
    path = str(tmp_path / "chunks")
    index.save(vectors, path)
    index.save(vectors.where("project_id = 'q'"), path)
    assert index.load(spark, path).count() == 3 and index.load(spark, path, "q").count() == 1
    assert "PartitionFilters: [isnotnull(project_id" in index.load(spark, path, "q")._jdf.queryExecution().toString()
    stats = {r.project_id: (r.files, r.chunks, r.vectors) for r in index.stats(chunks, vectors).collect()}
    assert stats == {"p": (1, 2, 2), "q": (1, 1, 1)}
    assert index.ready(chunks, vectors) and not index.ready(chunks.limit(0), vectors)
    assert (index.hashed(["a", "b"]) == index.hashed(["a", "b"])).all()
    listed = {r.path: r.types for r in files.listing(chunks.withColumn("file_name", chunks.path)).collect()}
    assert listed == {"a": "f,g", "b": ""}


def test_numbered(spark):
    df = spark.range(1000).selectExpr("cast(hash(id) as string) as path", "id % 7 as pos")
    got = files.numbered(df, ["path", "pos"]).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == list(range(1000)) and [(r.path, r.pos) for r in got] == sorted((r.path, r.pos) for r in got)


def test_source(spark):
    rows = _files(spark, [("a.py", "x\ny"), ("b.py", "z")])
    chunks = spark.createDataFrame([("p", "a.py")], "project_id string, path string")
    asked = spark.createDataFrame([("p", "a.py"), ("p", "b.py"), ("p", "zz")], "project_id string, path string")
    assert [(r.path, r.lines) for r in files.source(rows, chunks, asked).collect()] == [("a.py", 2)]
