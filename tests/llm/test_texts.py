import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import leakage, packing, provenance, reading, splitting

CHUNKS = "chunk_id long, project_id string, path string, file_name string, type string, name string, start_line int, end_line int, content string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .;{}é\t", max_size=90), max_size=60).map("\n".join), st.integers(20, 120), st.integers(0, 15))
def test_pieces_make_the_text_again(text, limit, overlap):
    parts = splitting.pieces(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e in parts) == text
    assert all(e - a <= limit for a, _, e in parts)
    assert all(s - a <= overlap and a >= p for (a, s, _), p in zip(parts[1:], [s for _, s, _ in parts]))
    if all(len(line) <= limit for line in text.split("\n")):
        assert all(e == len(text) or text[e - 1] == "\n" or text[e] == "\n" for _, _, e in parts)


def test_uneven_texts_are_cut_in_halves(monkeypatch):
    # Strong boundaries at one end only: each cut still leaves both sides at least a quarter.
    text = "\n\n".join("x = 1" for _ in range(50)) + "\n" + "\n".join("        deep(%d)" % n for n in range(20_000))
    calls = []
    cut = splitting._cut
    monkeypatch.setattr(splitting, "_cut", lambda *a: calls.append(a[2] - a[1]) or cut(*a))
    parts = splitting.pieces(text)
    assert "".join(text[s:e] for _, s, e in parts) == text and sum(calls) < 40 * len(text)


def test_splitting_frames(table):
    text = "\n".join(f"line {n} " + "x" * (n % 60) for n in range(100))
    rows = [(1, "p", "a", "a.py", None, "n", 10, None, text), (2, "p", "b", "b", "t", None, None, None, "y" * 5000), (3, "p", "c", "c", "t", "m", 1, 1, "short"), (4, None, None, None, None, None, None, None, None), (5, "p", "d", "d", "t", "m", 1, 1, "é" * 1600), (None, "p", "e", "e", "t", "m", 1, 1, "z" * 2000)]
    df = table(rows, CHUNKS)
    assert {r.chunk_id: r.cut for r in splitting.cut_kinds(df).collect()} == {1: "lines", 2: "inside"}
    got = {}
    for r in splitting.split_chunks(df).collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert {k: len(v) for k, v in got.items() if k in (3, 4, 5)} == {3: 1, 4: 1, 5: 1} and None not in got
    lines = text.split("\n")
    for r in got[1]:
        assert len(r.content) <= 1600 and r.content.rstrip("\n") in "\n".join(lines[r.start_line - 10 : r.end_line - 9])
        assert r.content.startswith(lines[r.start_line - 10][:5])
    assert "".join(r.content[r.overlap :] for r in sorted(got[1], key=lambda r: r.piece)) == text
    assert all(r.start_line is None for r in got[2])
    assert splitting.split_chunks(df.limit(0)).count() == 0


def _plain_best(room, sizes):
    reach = {0}
    for s in sizes:
        reach |= {r + s for r in reach if r + s <= room}
    return max(reach)


def test_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 14))]
        counts = np.bincount(sizes, minlength=101).astype(np.int64) if sizes else np.zeros(101, dtype=np.int64)
        used = packing._fill(100, counts)
        assert sum(s * n for s, n in used.items()) == _plain_best(100, sizes) and all(counts[s] >= n for s, n in used.items())


def test_packing(table):
    rng = random.Random(2)
    sizes = [0] * 50 + [7] * 200 + [rng.randrange(1, 300) for _ in range(300)] + [250, 101, 100]
    df = table([(n, " ".join(["w"] * s)) for n, s in enumerate(sizes)] + [(9000, None), (None, "w w")], "doc_id long, text string")
    got = packing.packed(df, 100).collect()
    total, filled, parts = {}, {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        filled[r.container_id] = filled.get(r.container_id, 0) + r.tokens
        parts.setdefault(r.doc_id, []).append(r.part)
    assert total == {**dict(enumerate(sizes)), 9000: 0}
    assert max(filled.values()) <= 100 and set(filled) == set(range(len(filled)))
    assert all(len(parts[n]) == max(1, -(-s // 100)) for n, s in enumerate(sizes))
    assert len(filled) <= -(-sum(sizes) // 100) + 3
    assert {r.doc_id for r in packing.oversized(df, 100).collect()} == {n for n, s in enumerate(sizes) if s > 100}
    assert packing.packed(df.limit(0)).count() == 0
    assert [r.container_id for r in packing.packed(table([(1, ""), (2, None)], "doc_id long, text string")).collect()] == [0, 0]


def test_tokens_are_those_of_the_definition(table):
    texts = ["a_b c-d", "x²½ _ é世界!", "  \x1c\u2003 ", "😀😀a", "tab\tnew\nline...", ""]
    got = {r.doc_id: r.tokens for r in packing.sized(table(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {n: len(re.findall(r"\w+|[^\w\s]", t)) for n, t in enumerate(texts)}


ITEMS = [(1, "In korvex the work is done by read_table. Between Mirlo and Tansa, 485 paper sheets were counted beside blue racks. Had Quorin not moved number 494, spare stock would follow Velda."), (2, "In narvik the work is done by load_page. Between Orbex and Sulmo, 112 paper sheets were counted beside blue racks. Had Tirsan not moved number 871, spare stock would follow Brenk."), (3, None), (4, "two words"), (None, "x y z w v u")]


def test_leaks(table):
    text = dict(ITEMS)[1]
    words = text.split()
    noise = "the table of the session is read by the loader when the server starts and the page is shown " * 3
    docs = [
        (1, noise + text + noise), (2, noise + text.upper().replace(",", "") + noise), (3, "// " + "\n// ".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5))),
        (4, noise + " ".join(words[: int(len(words) * 0.6)]) + " " + noise), (5, noise + " ".join(words[: int(len(words) * 0.2)]) + " " + noise), (6, noise),
        (7, noise + text.replace("korvex", "zumbal").replace("Mirlo", "Aldon").replace("Tansa", "Ferrix").replace("485", "77").replace("Quorin", "Hasbel").replace("494", "12").replace("Velda", "Jantu").replace("read_table", "drop_row") + noise),
        (8, None), (9, ""), (None, text), (10, noise + " ".join("changed" if k % 9 == 4 else w for k, w in enumerate(words)) + noise), (11, "<p>" + "</p> <p>".join(f"<b>{w}</b>" for w in words) + "</p>"),
    ] + [(100 + n, noise) for n in range(60)]
    df = table(docs, "doc_id long, text string")
    found = leakage.leaks(df, table(ITEMS, "item_id long, text string")).collect()
    assert {(r.item_id, r.doc_id) for r in found if r.kind == "verbatim"} == {(1, d) for d in (1, 2, 3, 4, 10, 11)}
    assert {(r.item_id, r.doc_id) for r in found if r.kind != "verbatim"} == {(1, 7)}
    assert leakage.leaks(df.limit(0), table(ITEMS, "item_id long, text string")).count() == 0
    assert leakage.leaks(df, table([], "item_id long, text string")).count() == 0


def _question(n, names, numbers):
    a, b, c = names
    return f"{a} owns {numbers[0]} wooden boats near the harbour of {b}. Every spring the owner sells {numbers[1]} boats to a merchant from {c}, who pays in silver coins. How many boats does {a} keep when the merchant from {c} has left {b}? Question of the {('first', 'second', 'third')[n % 3]} kind."


def test_reparameterised_questions(table):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    given = [[name() for _ in range(3)] for _ in range(40)]
    items = [(n, _question(n, given[n], [rng.randrange(10, 99) for _ in range(2)])) for n in range(40)]
    noise = "the table of the session is read by the loader when the server starts and the page is shown " * 3
    docs = [(n, noise + _question(n, [name() for _ in range(3)], [rng.randrange(10, 99) for _ in range(2)]) + noise) for n in range(160)]
    mixed = [(500, noise + " ".join(name() if w.strip(",.?") in given[0] or w[0].isdigit() else w for w in items[0][1].split()) + noise)]  # one value, many others: no mapping
    got = leakage.leaks(table(docs + mixed + [(600, items[3][1])], "doc_id long, text string"), table(items, "item_id long, text string")).collect()
    other = {r.doc_id for r in got if r.kind == "reparameterised"}
    assert other == set(range(160))  # neither the copy nor the text whose values keep to no mapping
    assert {(r.item_id, r.doc_id) for r in got if r.kind == "verbatim"} == {(3, 600)}
    assert {r.item_id for r in got if r.kind == "reparameterised"} <= {0, 1, 2}  # one item stands for its template


def test_repeated_windows(table):
    item = "the k7 of " * 30 + "the end"
    docs = table([(1, "the k7 of " * 20_000), (2, "nothing of it " * 50)], "doc_id long, text string")
    got = leakage.leaks(docs, table([(1, item)], "item_id long, text string")).collect()
    assert {(r.item_id, r.doc_id, r.kind) for r in got} == {(1, 1, "verbatim")}


def test_templates_decide(table, monkeypatch):
    # Without slots in its windows every text of an item's template would be taken for a copy.
    item = [(n, f"Before the session with {w}x ends the loader writes the table of {w}y to the page and the server of {w}z reads the table again.") for n, w in enumerate("ab cd ef gh ij kl mn op qr st uv wx yz ba dc fe hg ji lk nm po".split())]
    doc = table([(1, item[0][1].replace("abx", "zzq").replace("aby", "zzr").replace("abz", "zzs")), (2, item[1][1])], "doc_id long, text string")
    verbatim = lambda: {(r.item_id, r.doc_id) for r in leakage.leaks(doc, table(item, "item_id long, text string")).where("kind = 'verbatim'").collect()}
    assert verbatim() == {(1, 2)}
    monkeypatch.setattr(leakage, "common_words", lambda once, share=0.0: frozenset(r.w for r in once.selectExpr("explode(split(said, ' ')) as w").distinct().collect()))
    assert {(0, 1), (1, 1), (0, 2)} <= verbatim()


def test_leaks_of_quotes_without_slots(table):
    # The quoted part of an item holds words of all items only, its names and numbers stand in the rest.
    rng = random.Random(3)
    plain = "the loader reads page while server writes session table again before each user asks".split()
    heads = [rng.sample(plain, 14) + rng.sample(plain, 10) for _ in range(30)]
    items = [(n, " ".join(h + [f"{w}{chr(97 + n % 26)}{chr(97 + n // 26)}" for w in "bim bam bom kam kem kim kom kum lam lem lim lom lum nam nem nim nom num ram rem rim rom rum sam sem sim".split()])) for n, h in enumerate(heads)]
    noise = "nothing of it stands here " * 9
    docs = table([(1, noise + " ".join(heads[0]) + " " + noise), (2, noise + " ".join(heads[7][:21]) + " " + noise), (3, noise + " ".join(heads[9][:12]) + " " + noise)], "doc_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(docs, table(items, "item_id long, text string")).where("kind = 'verbatim'").collect()}
    assert got == {(0, 1), (7, 2)}


def test_leaks_of_short_items(table):
    items = [(1, "herons cross beneath broken towers slowly")] + [(10 + n, f"some other passage about w{chr(97 + n)}x here") for n in range(20)]
    docs = table([(1, "seen by night: herons cross beneath a bridge"), (2, "herons by night")], "doc_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(docs, table(items, "item_id long, text string")).where("kind = 'verbatim'").collect()}
    assert got == {(1, 1)}


def test_words_of_any_script():
    assert leakage.words("Größe_2x, Привет мир!") == ["größe", "2", "x", "привет", "мир"]
    assert leakage.words("日本語 text") == ["日", "本", "語", "text"]


def test_leaks_of_copied_items(table):
    # A passage without numbers under a third of the ids, and one nearly copied under others: all ids leak.
    first = "The pale harbour keeps silent watch while sleepy herons cross beneath broken towers and gather slowly near forgotten wells."
    near = "Every gardener who plants tulips before winter must cover tender bulbs with straw because frost destroys shallow roots {} quickly."
    items = [(n, first) for n in range(20)] + [(100 + n, near.format("so" if n % 2 else "too") + " " + w) for n, w in enumerate("very rather truly often never seldom".split())]
    items += [(200 + n, f"Some unrelated passage {n} about w{chr(97 + n)}x and v{chr(98 + n)}z items over there.") for n in range(20)]
    noise = "the table of the session is read by the loader when the server starts and the page is shown " * 3
    docs = table([(1, noise + first + noise), (2, noise + near.format("so") + noise), (3, noise)], "doc_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(docs, table(items, "item_id long, text string")).where("kind = 'verbatim'").collect()}
    assert got == {(n, 1) for n in range(20)} | {(100 + n, 2) for n in range(6)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=3, max_size=20), st.lists(st.sampled_from("abcdef"), max_size=30))
def test_common_subsequence(a, b):
    table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table_[i + 1][j + 1] = table_[i][j] + 1 if a[i] == b[j] else max(table_[i][j + 1], table_[i + 1][j])
    assert leakage.common_subsequence(a, b) == table_[-1][-1]


HAND = "import os\n\n\ndef read(path):\n    if not path:\n        return None\n    with open(path) as f:\n        return f.read()\n\n\nclass Reader:\n    def __init__(self, root):\n        self.root = root\n\n    def get(self, name):\n        return read(os.path.join(self.root, name))\n"
FIELDS = "".join(f"Row_{n}_FIELD = Field(number={n}, kind='str')\n" for n in range(20))
SQUEEZED = "".join(f"function _{k}(t,e){{return t*{k}+e.x}}var _v{k}={{a:{k},b:!0}};" for k in range(20)) + "\n"
TABLE = "export const rows = [\n" + "".join(f"  [{n}.5, {n}, -{n}.25],\n" for n in range(40)) + "];\n"
BANNER = "# fastlib v3.1.4 | (c) someone contributors | released under the Some licence\n\n" + HAND


def test_kinds(table):
    schema = "doc_id long, project_id string, path string, file_name string, content string"
    rows = [
        (1, "p", "src/a.py", "a.py", HAND), (2, "q", "src/a.py", "a.py", HAND),  # a copied hand-written file stays one
        (3, "p", "src/row_pb2.py", "row_pb2.py", FIELDS), (4, "p", "src/b.py", "b.py", "# Code generated by rowgen. DO NOT EDIT.\n" + HAND), (5, "p", "src/c.py", "c.py", HAND + "\n# writes the line 'do not edit' at the top\n"),
        (6, "p", "web/x.min.js", "x.min.js", SQUEEZED), (7, "p", "web/y.js", "y.js", "/*! y 1.2 */" + SQUEEZED), (8, "p", "web/rows.js", "rows.js", TABLE),
        (9, "p", "vendor/speedy/x.py", "x.py", HAND.replace("Reader", "Speedy")), (10, "q", "core/other.py", "other.py", HAND.replace("Reader", "Speedy").replace("\n", "\r\n")), (11, "q", "lib/z.py", "z.py", BANNER), (12, "q", "src/vendors/w.py", "w.py", HAND.replace("Reader", "Writer")),
        (13, "p", "src/broken.py", "broken.py", FIELDS + "(\n"), (14, "p", "readme.md", "readme.md", BANNER), (15, None, None, None, None), (16, None, "s.css", "s.css", ".a {\n  color: red;\n}\n.b {\n  color: blue;\n}\n"), (17, "p", "e.py", "e.py", ""), (None, "p", "f.py", "f.py", FIELDS),
    ]
    got = {r.doc_id: r.kind for r in provenance.not_handwritten(table(rows, schema)).where("valid").collect()}
    assert got == {3: "generated", 4: "generated", 6: "minified", 7: "minified", 8: "data", 9: "vendored", 10: "vendored", 11: "vendored"}
    assert provenance.not_handwritten(table([], schema)).count() == 0


def test_marks_below_a_notice():
    notice = "".join(f"// line {n} of the terms under which this may be used\n" for n in range(20))
    code = "package rows\n\nfunc Sum(xs []int) int {\n\ttotal := 0\n\tfor _, x := range xs {\n\t\ttotal += x\n\t}\n\treturn total\n}\n"
    mark = "// Code generated by rowgen. DO NOT EDIT.\n"
    for top in (notice, "\n".join(notice.split("\n")[:4]) + "\n\n", "/*\n" + notice.replace("// ", "") + "*/\n\n"):
        assert provenance.layout(top + mark + code, "rows.go") == "generated" and provenance.layout(top + code, "rows.go") is None
    assert provenance.layout(notice + "\n// fastlib v3.1.4\n// released under the Some licence\n" + code, "rows.go") == "banner"
    assert provenance.layout(notice + code.replace("\ttotal := 0\n", "\ttotal := 0\n\t" + mark + "\ttotal += 0\n"), "rows.go") is None


def test_short_files_of_a_vendored_folder(table):
    big, short = HAND.replace("Reader", "Speedy"), "from .x import Speedy\n"
    files = [("p", "vendor/speedy/x.py", big), ("p", "vendor/speedy/init.py", short), ("q", "lib/fast/y.py", big), ("q", "lib/fast/start.py", short), ("q", "src/init.py", short), ("q", "src/own.py", HAND)]
    rows = [(n, project, path, path.rpartition("/")[2], text) for n, (project, path, text) in enumerate(files)]
    got = {r.doc_id: r.kind for r in provenance.not_handwritten(table(rows, "doc_id long, project_id string, path string, file_name string, content string")).collect()}
    assert got == dict.fromkeys(range(4), "vendored")


def _own(project, n):
    return [(project, f"src/own{k}.py", HAND.replace("Reader", f"Own{project}{k}")) for k in range(n)]


def _kinds(table, files):
    rows = [(n, project, path, path.rpartition("/")[2], text) for n, (project, path, text) in enumerate(files)]
    found = {r.doc_id: r.kind for r in provenance.not_handwritten(table(rows, "doc_id long, project_id string, path string, file_name string, content string")).collect()}
    return {(p, path): found.get(n) for n, (p, path, _) in enumerate(files)}


LIBRARY = [("core/io.py", HAND.replace("Reader", "Speedy")), ("core/net.py", HAND.replace("Reader", "Swift")), ("top.py", HAND.replace("Reader", "Top")), ("mark.py", "x = 1\n")]


def test_shared_subtrees_are_vendored(table):
    # No vendor folder, version or banner anywhere: unrelated repositories share the tree, and that decides.
    files = _own("p", 9) + _own("q", 9) + [("p", "lib/fast/" + f, t) for f, t in LIBRARY] + [("q", "assets/" + f.upper(), t) for f, t in LIBRARY]
    files = [(p, f.replace(".PY", ".py"), t) for p, f, t in files]
    got = _kinds(table, files)
    assert {k for k, v in got.items() if v == "vendored"} == {(p, f) for p, f, _ in files if "own" not in f}
    # The same tree in a fork says nothing: most of the two repositories is the same.
    fork = _own("p", 9) + [(p.replace("p", "r"), f, t) for p, f, t in _own("p", 9)] + [(p, "lib/" + f, t) for p in "pr" for f, t in LIBRARY] + [("r", "src/more.py", HAND.replace("Reader", "More"))]
    assert set(_kinds(table, fork).values()) == {None}
    # Nor does a tree whose copies lie in one repository.
    assert set(_kinds(table, _own("p", 9) + [("p", d + f, t) for d in ("a/", "b/") for f, t in LIBRARY]).values()) == {None}


def test_merkle_nodes_decide(table, monkeypatch):
    files = _own("p", 9) + _own("q", 9) + [("p", "vendor/fast/" + f, t) for f, t in LIBRARY] + [("q", "assets/" + f, t) for f, t in LIBRARY]
    with_nodes = {k for k, v in _kinds(table, files).items() if v}
    monkeypatch.setattr(provenance, "subtrees", lambda leaves: leaves.limit(0))
    assert with_nodes - {k for k, v in _kinds(table, files).items() if v} == {("q", "assets/mark.py")}


def test_short_files_do_not_part_copies(table):
    # An empty or short file among a tree's files counts by its text, so the trees above stay equal.
    short = [*LIBRARY, ("core/__init__.py", ""), ("__init__.py", "")]
    files = _own("p", 9) + _own("q", 9) + [("p", "lib/fast/" + f, t) for f, t in short] + [("q", "tools/" + f, t) for f, t in short]
    assert {k for k, v in _kinds(table, files).items() if v} == {(p, f) for p, f, _ in files if "own" not in f}


def test_merkle_hashes_ignore_names_and_order(table):
    rows = [("p", "a/x/1.py", 11), ("p", "a/x/2.py", 12), ("q", "b/c/y/k.py", 12), ("q", "b/c/y/z.py", 11), ("q", "b/other.py", 5)]
    leaves = table([(p, path, h, 1, h, h, True) for p, path, h in rows], "project_id string, path string, hash long, files long, least long, most long, long boolean", extra=False)
    got = {(r.project_id, r.path): (r.hash, r.files, r.least, r.most) for r in provenance.subtrees(leaves).collect()}
    assert got["p", "a/x"][0] == got["p", "a"][0] == got["q", "b/c/y"][0] == got["q", "b/c"][0] != got["q", "b"][0]
    assert got["q", "b"][1:] == (3, 5, 12) and got["p", "a"][1:] == (2, 11, 12)


EASY = ["Open the file and read it.", "We fix the list by hand.", "The page is new.", "You can add a small note.", "Is the link old? Then save it.", "Now send the short form.", "Do not move the box yet.", "The run is slow today.", "Check the desk again.", "Keep the old word."]
HARD = ["Notwithstanding the probabilistic idempotency of the architecture, its hierarchical materialization approximates a level of serialization that no conventional interpretation is able to circumscribe.", "Insofar as heterogeneous linearizability substantiates disambiguation, practitioners who investigate interoperability must also accommodate asynchronous dependencies between successive canonicalizations."]
PLAIN = ["The person who built the router has to restart the server every second night because the cache is full.", "Our loader job reads the table of the session twice before the page is shown to the other users."]


@pytest.fixture(scope="module")
def graded(table):
    rng = random.Random(4)
    docs, labels = [], []
    for n in range(240):
        pool, grade = ((EASY, 1), (PLAIN, 3), (HARD, 5))[n % 3]
        docs.append((n, " ".join(rng.choice(pool) for _ in range(12)), None))
        if n < 60:
            labels.append((n, grade, "r"))
    docs += [(1000, " ".join(EASY), "x.py"), (1001, " ".join(EASY[:4]), None), (1002, " ".join(s.replace("file", "idempotency").replace("page", "serialization").replace("list", "heterogeneity") for s in EASY[:3] * 4), None), (1003, " and then ".join(s.rstrip(".?").lower() for s in EASY) + ".", None), (1004, None, None), (1005, "", None), (1006, "Le programme lit la table. " * 12, None), (1007, "# Head\n\n```\ncode. More code.\n```\n\n" + "\n".join("- " + s for s in EASY * 2), None), (None, " ".join(EASY), None), (1008, "word " * 50_000, None)]
    labels += [(5, None, "r"), (None, 3, "r"), (0, 2, "s"), (99_999, 3, "r")]
    return table(docs, "doc_id long, text string, path string"), table(labels, "doc_id long, grade int, rater string")


def test_levels(graded):
    docs, labels = graded
    rows = {r.doc_id: r for r in reading.levels(docs, labels).collect()}
    assert None not in rows and 1000 not in rows
    for n in range(240):
        assert rows[n].level == ("basic", "other", "advanced")[n % 3], n
    assert {n: rows[n].level for n in range(1001, 1009)} == {1001: "other", 1002: "other", 1003: "other", 1004: None, 1005: None, 1006: None, 1007: "basic", 1008: None}
    assert np.mean([rows[n].grade for n in range(0, 240, 3)]) + 1 < np.mean([rows[n].grade for n in range(1, 240, 3)]) < np.mean([rows[n].grade for n in range(2, 240, 3)]) - 0.5
    assert 1000 in {r.doc_id for r in reading.levels(docs, labels, prose_only=False).collect()}


def test_levels_rest_on_graded_words(graded):
    # Without graded texts no word has a grade, and no document a level: nothing else decides.
    docs, labels = graded
    rows = reading.levels(docs, labels.limit(0)).collect()
    assert rows and all(r.level is None and r.grade is None for r in rows)
    assert reading.levels(docs.limit(0), labels).count() == 0
    # Turned grades turn the levels.
    turned = {r.doc_id: r for r in reading.levels(docs, labels.selectExpr("doc_id", "6 - grade as grade", "rater")).collect()}
    assert np.mean([turned[n].grade for n in range(0, 240, 3)]) > np.mean([turned[n].grade for n in range(2, 240, 3)])


def test_quantile():
    rng = random.Random(3)
    for n in (1, 2, 7, 30):
        x = sorted(rng.random() for _ in range(n))
        assert all(abs(reading._quantile(x, q) - np.quantile(x, q)) < 1e-12 for q in (0.0, 0.3, 0.5, 0.9, 1.0))
