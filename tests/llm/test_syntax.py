import json
import random
from pathlib import Path

import pytest

from quarry.llm import syntax

HERE = Path(__file__).parent / "sources"
VALID = {"javascript": "valid.js", "typescript": "valid.ts", "java": "Valid.java", "go": "valid.go", "python": "valid_py.txt"}


def source(language):
    return (HERE / VALID[language]).read_text()


@pytest.mark.parametrize("language", VALID)
def test_valid_sources_parse(language):
    text = source(language)
    assert syntax.defect(text, language) is None
    assert syntax.defect("﻿" + text.replace("\n", "\r\n"), language) is None


@pytest.mark.parametrize("language", VALID)
def test_dropped_brackets_and_cuts_are_found(language):
    text, rng = source(language), random.Random(1)
    at = [k for k, c in enumerate(text) if c in "()[]{}"]
    missed = sum(syntax.defect(text[:k] + text[k + 1 :], language) is None for k in rng.sample(at, 50))
    assert missed <= 9  # brackets inside literals and comments are among them
    marked = text.replace("\n\n", "\n", 1) + "\n<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> other\n"
    assert syntax.defect(marked, language) == "merge conflict"


@pytest.mark.parametrize("language", VALID)
def test_other_languages_do_not_parse(language):
    for other in VALID:
        if other != language and not (language == "typescript" and other == "javascript"):
            assert syntax.defect(source(other), language), other
    assert syntax.defect("<!doctype html>\n<html>\n<body><p>It's here</p></body>\n</html>", language)


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("python", 'print "x"'), ("python", "def f(:\n  pass"), ("python", "if x:\npass"), ("python", "x = 'abc"), ("python", 'x = """abc'), ("python", "def f():\n    a\n   b"), ("python", "x = 1\0"),
        ("javascript", "const x = ;"), ("javascript", "const x: number = 1"), ("javascript", "let s = 'abc"), ("javascript", "/* open"), ("javascript", "`${a"), ("javascript", "try { f() }"), ("javascript", "return 1"), ("javascript", '{"a": 1}'), ("javascript", "foo bar"),
        ("typescript", "const x: number = "), ("typescript", "foo bar baz"), ("java", "class A { int x = 1 }"), ("java", "class A { void f() { g() } }"), ("java", "class A { String s = 'abc'; }"), ("java", "int x = 1;"),
        ("go", "func main() {}"), ("go", "package a\nx := 1"), ("go", "package a\nvar s = \"abc\n"),
        ("json", ""), ("json", "{'a': 1}"), ("json", "[1,]"), ("json", "[1] [2]"), ("json", "NaN"), ("json", "// c\n1"), ("json", "[01]"), ("json", '{"a"}'), ("json", "[" * 50_000),
    ],
)
def test_invalid(language, text):
    assert syntax.defect(text, language)


@pytest.mark.parametrize("text", ["1", " null\n", '"\\u00e9"', "[]", "{}", '{"a": [1, -2.5e3, {"b": null}], "a": true}', "﻿[]"])
def test_valid_json(text):
    assert syntax.defect(text, "json") is None


def test_json_agrees_with_the_parser():
    rng = random.Random(5)
    base = json.dumps({"a": [1, 2.5, {"b": None, "c": [True, "x\\y"]}], "d": {}}, indent=1)
    for _ in range(400):
        k = rng.randrange(len(base))
        text = base[:k] + rng.choice(["", '"', "{", "]", ",", ":", "1", "x"]) + base[k + rng.randrange(3) :]
        try:
            json.loads(text, parse_constant=syntax._refuse)
            valid = True
        except ValueError:
            valid = False
        assert (syntax.defect(text, "json") is None) == valid, text


@pytest.mark.parametrize("language", ["javascript", "typescript", "java", "go", "python"])
def test_empty_and_long(language):
    assert (syntax.defect("", language) is None) == (language not in ("go",)) or language == "go"
    long = {"javascript": "f(1);\n", "typescript": "f(1);\n", "python": "f(1)\n"}.get(language)
    if long:
        assert syntax.defect(long * 20_000, language) is None
        assert syntax.defect("(" * 50_000, language)


def test_frames(table):
    schema = "doc_id long, project_id string, path string, file_name string, content string"
    rows = [(1, "p", "a", "a.py", "x = 1"), (2, "p", "b", "b.PY", "x ="), (3, None, "c", "c.json", ""), (4, "p", None, None, None), (5, "p", "d", "d.md", "x ="), (6, "p", "e", "e.js", None), (7, "p", "f", "f.py", "\r\nx = 1\r")]
    got = {r.doc_id: (r.language, r.defect is None) for r in syntax.parse_defects(table(rows, schema)).collect()}
    assert got == {1: ("python", True), 2: ("python", False), 3: ("json", False), 7: ("python", True)}
    rates = {(r.project_id, r.language): (r.files, r.invalid, r.share) for r in syntax.defect_rates(table(rows, schema)).collect()}
    assert rates == {("p", "python"): (3, 1, 1 / 3), (None, "json"): (1, 1, 1.0)}
    assert syntax.parse_defects(table([], schema)).count() == 0


# Small invalid sources that are found.
BROKEN = {
    "javascript": [
        'let x = 1 let y = 2',
        'for (let i = 0; i < 3) {}',
        'if (x { y() }',
        'function (a) {}',
        'let 1x = 2',
        'const a;',
        'x = = 1',
        'a.b. = 2',
        'f(1 2)',
        'if x { }',
        'var a = [1, 2',
        'class { }',
        'class A { x = 1 y = 2 }',
        'else { f() }',
        'return',
        'a ? b',
        'x => => y',
        'let a = b c',
        'while () {}',
        "import { a } fro 'b'",
        'export default',
        '({a: 1, b 2})',
        'const {a, b = c',
    ],
    "typescript": [
        'let x: = 1;',
        'let x = 1 let y = 2',
        'interface { a: string }',
        'interface A { a string }',
        'function f(a: ) {}',
        'const x: number = ;',
        'class A { private x: }',
        'enum A { B C }',
        'for (let i = 0; i < 3) {}',
        'let x as number = 1 2',
        "import { A } fro 'b'",
        'else { f() }',
        'f(1 2)',
    ],
    "go": [
        'package a\nfunc f() { x = y z }',
        'package a\nfunc f() { if x = 1 { } }',
        'package a\nfunc f( { }',
        'package a\nfunc f() { for i := 0; i < 3 { } }',
        'package a\nfunc f() { x := }',
        'package a\nfunc f() { else { } }',
        'package a\nvar x int y',
        'package a\nfunc f() { return 1 2 }',
        'package a\ntype T struct { a int b int }',
        'package a\nimport fmt',
        'package\nfunc f() {}',
        'package a\nfunc f() { x := [1, 2] }',
        'package a\nfunc f() int { return }}',
        'package a\nfunc f() { if x { } else y() }',
        'package a\nfunc f()\n{\n}',
        'package a\nfunc f() { g(1 2) }',
        'package a\nfunc f() { var = 1 }',
    ],
    "java": [
        'public clas A {}',
        'class A { void f() { else {} } }',
        'class A { void f() { int x = ; } }',
        'class A { void f() { x = 1 y = 2; } }',
        'class A { void f( { } }',
        'class { }',
        'class A { int 1x; }',
        'class A { void f() { for (int i = 0; i < 3) {} } }',
        'class A { void f() { if x { } } }',
        'class A { void f() { return 1 2; } }',
        'class A { void f() { g(1 2); } }',
        'class A { void f() { try { } } }',
        'class A { public void }',
        'import a.b\nclass A {}',
        'class A { void f() { while () {} } }',
        'class A extends { }',
        'class A { int[] a = {1, 2; }',
    ],
}

# Invalid, but not seen: names of the wrong kind, statements in the wrong place.
MISSED = {
    "javascript": [
        'switch (x) { foo }',
        'new',
    ],
    "typescript": [
        'type = string',
        'type A string',
        'let a: Array<string = []',
    ],
    "java": [
        'class A { void f() { case 1: g(); } }',
    ],
}

# Small valid sources.
SOUND = {
    "javascript": [
        'async function f() { for await (const x of y) g(x) }',
        'for (;;) { break }',
        'for (const k in o) f(k)',
        'do x(); while (y)',
        'do { x() } while (y)\nlet z = 1',
        'if (a) b(); else c()',
        'const o = { else: 1, let: 2, do: 3, for: 4, get a() { return 1 }, set a(v) {}, async *g() {} }',
        'label: for (let i = 0, j = 1; i < j; i++) { continue label }',
        'switch (x) { case 1:; default: }',
        'export default class {}',
        'export default function () {}',
        'class A { static x = 1; #y; static { f() } static async *g() {} }',
        'const f = async x => { await x }, g = ({a, b: [c]}, ...d) => a',
        'let a = b\n/c/g.test(d)',
        'x = a ? b : c ? d : e',
        'var { a, b = 2, ...c } = d',
        'let x = y\nlet z = 2',
        "import a, { b as c } from 'd'\nimport * as e from 'f'\nexport * from 'g'\nexport { a as default }",
        'if (a) for (;;) {}',
        'const t = `a${b + `c${d}`}e`',
        'a?.b?.[c]?.(d) ?? e',
        "throw new Error('x')",
        'try { a() } catch { b() } finally { c() }',
        'new Foo',
        "typeof x === 'y' && void 0",
        'x = function* () { yield* y }',
        'while (a) b\nfor (x of y) z',
    ],
    "typescript": [
        'let x: number = 1\nlet y = 2',
        'type A<T> = { [K in keyof T]?: T[K] } | null',
        'interface A<T extends B = C> extends D { a?: string; readonly b: number; (x: number): string; new (y: string): A<T>; [k: string]: any }',
        'abstract class A<T> extends B<T> implements C, D { private readonly x: number = 1; constructor(public a: string, private b?: number) { super() } abstract f(): void; static g<T>(x: T): x is T { return true } }',
        "enum A { B = 1, C, D = 'x' }",
        "declare module 'x' { export const a: string }",
        'function f(this: A, a?: number, ...b: string[]): asserts a is number {}',
        'const x = y as const',
        'let f = <T,>(a: T): T => a',
        "import type { A } from 'b'",
        "export type { A } from 'b'",
        'let a!: string',
        'const x = y!',
        'namespace A.B { export let c = 1 }',
        'type F = (a: string) => void',
        "let t: [a: string, b?: number] = ['x']",
        'function g(a: string): void\nfunction g(a: number): void\nfunction g(a: any) {}',
        'type C = A extends infer U ? U : never',
        'switch (x) { case 1: { break } default: f() }',
        'for (let i = 0; i < 3; i++) {}',
        'let u = a satisfies B',
    ],
    "go": [
        'package a\n\nimport (\n\tf "fmt"\n\t_ "x"\n)\n',
        'package a\nfunc f() { if x := g(); x > 1 { } else if y { } else { } }',
        'package a\nfunc f() { for i := range x { } ; for { } ; for i, j := 0, 1; i < j; i++ { } ; for x { } }',
        'package a\nfunc f() { switch x := y.(type) { case int, string: g() ; default: } }',
        'package a\ntype T[K comparable, V any] struct {\n\tA, B int `json:"a"`\n\t*C\n\td func(int) (string, error)\n}',
        'package a\nfunc (r *T) F(a, b int, c ...string) (x int, err error) { defer g(); go func() { }(); return }',
        'package a\nvar (\n\tx = map[string][]int{"a": {1, 2}}\n\ty chan<- int\n)',
        'package a\nfunc f() { select { case v, ok := <-c: _ = v ; case c <- 1: } }',
        'package a\nfunc f() { x := struct{ a int }{1}; p := &x; *p = y; _ = x.a }',
        'package a\nconst (\n\tA = iota\n\tB\n)',
        'package a\ntype I interface {\n\tF(int) string\n\t~int | ~string\n}',
        'package a\nfunc f() { var x T = y; if v, ok := m[k]; ok { } ; x += 1 }',
        'package a\nfunc f() { if f := func() bool { return true }(); f { } }',
        'package a\nfunc f() {\nouter:\n\tfor {\n\t\tbreak outer\n\t}\n}',
        'package a\ntype A = B\nvar f = func(a int) int { return a }',
    ],
    "java": [
        'public non-sealed class A extends B {}',
        'sealed interface A permits B, C {}\nfinal class B implements A {}',
        'record A<T>(int a, T b) implements C { A { if (a < 0) throw new X(); } }',
        'public record P(int x) {}',
        'package a.b;\nimport static c.D.*;\nimport e.F;\n@G(h = 1, i = {"x"}) public class A<T extends B & C> extends D<T> implements E, F { @Override public void f() throws X { } }',
        'class A { void f() { if (a) b(); else c(); do { d(); } while (e); do f(); while (g); for (;;) { } for (int i : x) { } for (int i = 0, j = 1; i < j; i++, j--) g(); } }',
        'class A { int f(int x) { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }',
        'class A { String s = """\n  x "y"\n  """; int[][] a = {{1}, {2}}; List<Map<String, ? super T>> l = new ArrayList<>() {{ add(1); }}; }',
        'enum A { B(1) { void f() { } }, C(2); A(int x) { } }',
        'class A { static { } { } A() { this(1); } <T> T g(T... t) { return t[0]; } Runnable r = () -> { }; F h = A::new; }',
        '@interface A { int b() default 1; }',
        'class A { void f() { try (X x = y(); Z z = w) { } catch (B | C e) { } finally { } synchronized (this) { } a: while (true) break a; } }',
        'class A { void f(Object o) { if (o instanceof String s && s.length() > 1) { } int x = a ? b : c; char d = \'\\u0041\'; assert x > 1 : "y"; throw new E(); } }',
        'class A { non.B c; int non; }',
    ],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in BROKEN.items() for t in ts])
def test_broken_snippets(language, text):
    assert syntax.defect(text, language)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in SOUND.items() for t in ts])
def test_sound_snippets(language, text):
    assert syntax.defect(text, language) is None


def test_known_misses_are_few():
    assert sum(map(len, MISSED.values())) <= 0.1 * sum(map(len, BROKEN.values()))
