import pytest

from quillspark.llm import codefiles, provenance, syntax
from quillspark.llm.grammar import error_of

VALID = {
    "javascript": [
        "", "let a=1, {b,c:[d]}=x; for(const q of y){await z(q)} export default async (a,b=2)=>({a,[b]:1,...c});",
        "class A extends B{#x=1;static y; get z(){return this.#x} async *g(){yield* h()}}\nconst r=/a[/]b/g.test(s)?`x${a+1}y`:null", "if(a>=b>>>2){}else if(c){}\nlbl: for(;;){break lbl}", "x = a\n++b\nvar f = function(){ return\n1 }",
        "try { f() } catch { g() } finally { h() }\nswitch (a) { case 1: case 2: b(); break; default: }", "const s = '=======';\n// <<<<<<< HEAD\nlet t = `\n=======\n`;", "new Foo; a?.b?.[c]?.(d); a ??= b; let {x = 1, ...y} = z; import('x').then(({default: d}) => d)",
    ],
    "typescript": [
        "interface A<T>{a?:string;b(x:number):void;[k:string]:any}\ntype X<T>=T extends string?Array<Map<string,T[]>>:never;\nenum E{A=1,B}", "export const f=async <T,>(a:T,b?:number):Promise<T>=>{return a as unknown as T};", "abstract class Q<T> extends R<T> implements S{private readonly x!:number;constructor(private a:string,public b=2){super()} abstract z():void}",
        "let v=foo<string>(a)!.b; declare module 'x'{}\nimport type {A} from 'a'; function f(this: X, ...r: string[]): r is Y[] {}", "const out: string[] = [], n: number[][] = [[1,2],[3]];",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\nfunc (s *T) M(n int, xs ...string) (int, error) {\n\tif v, ok := m[n]; ok && v > 1 {\n\t\treturn v, nil\n\t}\n\tfor i, x := range xs {\n\t\tgo func() { ch <- x }()\n\t}\n\tswitch t := x.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\t}\n\treturn 0, fmt.Errorf(\"}\")\n}\n",
        "package a\n\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\ntype I interface {\n\tM(int) string\n\t~int | string\n}\n\nvar m = map[string][]int{\"a\": {1, 2}, \"(\": nil}\n\nconst (\n\tX = iota\n\tY\n)\n",
    ],
    "java": [
        "package a.b;\n\nimport java.util.*;\n\n@A(x = 1, y = {\"z\"})\npublic final class C<T extends D & E> implements F<T> {\n  private static final int[] X = {1, 2};\n  static { f(); }\n  C(int... a) throws G { this.a = (T) b; }\n  <U> U m(List<? super U> l) { for (var x : l) { x.y(z -> z + 1, C::new); } return l.isEmpty() ? null : (U) l.get(0); }\n  enum K { A(1) { void q() {} }, B; }\n  record P(int x) {}\n}\n",
        "class A { int f(Object o) { return switch (o) { case String s when s.isEmpty() -> 1; case Integer i -> { yield 2; } default -> 3; }; } String t = \"\"\"\n  text \"quoted\" {\n  \"\"\"; int i = a << 2 >>> 1; List<Map<String, int[]>> m = new ArrayList<>() {}; }",
    ],
    "sql": [
        "-- it's ((\nCREATE TABLE t (\n id BIGINT NOT NULL,\n n VARCHAR(20) DEFAULT 'a(b',\n PRIMARY KEY (id)\n);\nSELECT id, COUNT(*) AS n FROM t WHERE (a <> 'x' AND b > 3) GROUP BY id HAVING COUNT(*) > 1 ORDER BY 2 DESC LIMIT 5;",
        "WITH a AS (SELECT 1 AS x) SELECT CASE WHEN x IN (1, 2) THEN 'a' ELSE NULL END FROM a LEFT JOIN b USING (x) WHERE x BETWEEN 1 AND 2 AND y IS NOT NULL", "INSERT INTO t (a, b) VALUES (1, 'it''s'), (2, NULL);\nUPDATE t SET a = a + 1 WHERE b LIKE 'x%';\nDELETE FROM t;",
    ],
    "python": ["", "def f(a, /, b, *, c=1) -> int:\n    return a\n", "\"\"\"\n=======\n\"\"\"\nx: int = 1\nmatch x:\n    case 1: pass\n"],
    "json": ['{"a": [1, null, "x"]}'],
    "yaml": ["a:\n  - b: 1\n    c: 'x'\n"],
}
INVALID = {
    "javascript": ["const x;", "a b", "function f(){", "let a = ;", "if (a { }", "<<<<<<< HEAD\nlet a = 1;\n=======\n", "def f(x):\n    return x\n", "return (a));", "let s = 'abc;\n", "The list counts the rows.", "a:\n  b: 57\n  c:\n    - name: x\n"],
    "typescript": ["interface A { b: ", "let x: = 1", "class A { x: number y: string }", "type = 3 4"],
    "go": ["func f() {}", "package a\nfunc f() {\n", "package a\nvar x = \n", "package a\nfunc f() { return ) }", "package a\n=======\n", "<!DOCTYPE html>"],
    "java": ["class A { int f( { } }", "class A { int x = 1 }", "package a;\nclass A { void f() { return x.trim()) + 1; } }", "import x", "class A { void f() { a b c; } }", "package main\n\nfunc f() {}\n"],
    "sql": ["SELECT a FROM", "CREATE TABLE t (id INT", "SELECT a b c FROM t", "SELECT a FROM t GROUP BY", "<html></html>", "The list counts rows.", "<<<<<<< HEAD\nSELECT 1;\n"],
    "python": ["def f(:\n", "<<<<<<< HEAD\nx = 1\n", "x = 'abc\n", "package a;\n", "print 'x'\n"],
    "json": ["", '{"a": }', '{"a": 1,}', "{'a': 1}", '{"a": NaN}'],
    "yaml": ["a: b: c\n", "a: [1, 2\n", "<<<<<<< ours\na: 1\n=======\n  b: 2\n c\n", "a:\n\t- b\n"],
}


@pytest.mark.parametrize("language", VALID)
def test_grammars_accept(language):
    memory: dict = {}
    for code in VALID[language]:
        assert error_of(code, language, memory) is None, (code, error_of(code, language, {}))


@pytest.mark.parametrize("language", INVALID)
def test_grammars_reject(language):
    memory: dict = {}
    for code in INVALID[language]:
        assert error_of(code, language, memory) is not None, code


def test_verdicts():
    py, go = "import os\n\n\ndef f(x):\n    return None\n", VALID["go"][0]
    assert syntax.verdict(go, "python", {})[:2] == ("wrong_extension", "go")
    assert syntax.verdict(py, "go", {})[:2] == ("wrong_extension", "python")
    assert syntax.verdict("x = 1\n<<<<<<< HEAD\ny = 2\n=======\nz = (\n", "python", {})[0] == "conflict"
    assert syntax.verdict("def f(x):\n    return (x", "python", {})[0] == "corrupt"
    assert syntax.verdict("[" * 3000, "json", {})[0] == "corrupt"
    assert syntax.verdict("package a\n\nfunc f() {\n\treturn\n}\n", "yaml", {})[:2] == ("wrong_extension", "go")
    assert syntax.verdict("a: 1\nb: [x, y]\n", "yaml", {})[0] == syntax.verdict("just a few plain words\n", "yaml", {})[0] == "valid"
    assert syntax.verdict(py, None, {}) == ("unsupported", "python", None)


def test_deep_nesting_is_no_error():
    for n in (50, 400):
        assert error_of("function f() " + "{ if (a) " * n + "{ b(); }" + "}" * n, "javascript", {}) is None
        assert error_of("package a\n\nfunc f() {\n" + "if a {\n" * n + "b()\n" + "}\n" * n + "}\n", "go", {}) is None
        assert error_of("x = `" + "${`" * n + "a" + "`}" * n + "`;", "javascript", {}) is None
    assert syntax.verdict("[" * 200_000 + "]" * 200_000, "json", {})[0] == "undecided"


CHUNK = "id string, indexed_at timestamp, chunk_index int, content string, file_size long, git_project_identifier string, file_path string, lines int, node string"


def chunks(spark, files):
    from datetime import datetime

    rows = []
    for n, (g, p, code) in enumerate(files):
        half = len(code or "") // 2
        for k, part in enumerate([code] if code is None else [code[:half], code[half:]]):
            row = (f"{n}-{k}", datetime(2025, 1, 1), k, part, None, g, p, 1, "x")
            rows += [row, row] if n % 2 else [row]
    return spark.createDataFrame(rows, CHUNK)


def test_files_are_joined_and_checked(spark):
    f = codefiles.files(chunks(spark, [("a#main", "/x/a.py", "def f():\n    return 1\n"), ("a#main", "/x/b.PY", "def f(:\n"), ("a#main", "/x/c.json", None), ("a#main", "/x/d.bin", "x"), (None, "/x/e.go", "package a\n")]))
    got = {r["file_path"]: r["verdict"] for r in syntax.checked(f).collect()}
    assert got == {"/x/a.py": "valid", "/x/b.PY": "corrupt", "/x/c.json": "corrupt", "/x/d.bin": "unsupported", "/x/e.go": "valid"}
    assert {r["file_path"] for r in syntax.invalid(syntax.checked(f)).collect()} == {"/x/b.PY", "/x/c.json"}
    rates = {(r["git_project_identifier"], r["language"]): r["invalid_rate"] for r in syntax.rates(syntax.checked(f)).collect()}
    assert rates[("a#main", "python")] == 0.5 and rates[("a#main", None)] is None
    assert syntax.checked(codefiles.files(chunks(spark, [("a#main", "/x/a.py", "")]).limit(0))).count() == 0


def library(seed, n=20):
    return "\n".join(f"export function step{seed}{i}(value) {{ return transform_{seed}_{i * 7}(value, {i * 13 + seed}); }}" for i in (j * j for j in range(n))) + "\n"


def test_provenance(spark):
    lib, own = library(1), library(2)
    edited = lib.replace("step11(", "renamed(").replace("step14(", "other(") + "export const extra = lib.extra(value, 3);\n"
    both_a, both_b = library(5) + "export const a = 1;\nexport const only_a = 22;\n", library(5) + "export const b = 3;\nexport const only_b = 44;\n"
    files = [
        ("p1#main", "/p1/src/tool.js", lib), ("p2#main", "/p2/lib/x.js", "// Copyright 2025 team\n" + lib), ("p3#main", "/p3/y.js", edited),
        ("p4#main", "/p4/own.js", own), ("p4#dev", "/p4-wt/own.js", own), ("p5#main", "/p5/a.js", both_a), ("p6#main", "/p6/b.js", both_b),
        ("p4#main", "/p4/gen.go", "// Code generated by tool v1. DO NOT EDIT.\n\npackage a\n"), ("p4#main", "/p4/by.py", "# The parser was once generated; this one is written by hand.\nx = 1\n"),
        ("p4#main", "/p4/vendor_note.js", "// Do not edit the list while it is being read.\nlet a = 1;\n"), ("p4#main", "/p4/min.js", "var a=function(b){return b+1};" * 30),
        ("p4#main", "/p4/data.json", "[" + ",".join(f'{{"id": {i}, "v": {i * 2}}}' for i in range(40)) + "]"), ("p4#main", "/p4/conf.json", '{"a": 1, "b": {"c": [1, 2]}}'),
        ("p4#main", "/p4/rows.sql", "".join(f"INSERT INTO t VALUES ({i}, 'x{i}');\n" for i in range(30))), ("p4#main", "/p4/table.py", "T = [" + ", ".join(str(i * 7919 % 10007) for i in range(200)) + "]\n"),
        ("p4#main", "/p4/__init__.py", "\n"), ("p5#main", "/p5/__init__.py", "\n"), ("p4#main", "/p4/none.py", None),
    ]
    got = {r["file_path"]: r["kind"] for r in provenance.not_handwritten(codefiles.files(chunks(spark, files))).collect()}
    assert got == {
        "/p1/src/tool.js": "vendored", "/p2/lib/x.js": "vendored", "/p3/y.js": "vendored", "/p5/a.js": "vendored", "/p6/b.js": "vendored", "/p4/gen.go": "generated",
        "/p4/min.js": "minified", "/p4/data.json": "data", "/p4/rows.sql": "data", "/p4/table.py": "data",
    }
    assert provenance.not_handwritten(codefiles.files(chunks(spark, files).limit(0))).count() == 0


def vendored(spark, files):
    return {r["file_path"] for r in provenance.not_handwritten(codefiles.files(chunks(spark, files))).collect()}


def changed(lib, k):
    """A copy with a line of its own in place of one, and one more."""
    lines = lib.strip().split("\n")
    lines[k % len(lines)] = f"export const changed_in_{k} = own_value_{k};"
    return "\n".join([*lines, f"export const added_in_{k} = {k};"]) + "\n"


def test_copies_that_many_projects_edited(spark):
    few, many = library(11), library(12)
    files = [(f"a{k}#main", f"/a{k}/few.js", changed(few, k)) for k in range(8)] + [(f"b{k}#main", f"/b{k}/many.js", changed(many, k)) for k in range(40)]
    part = "\n".join(many.split("\n")[:9]) + "\n" + library(13, 11)
    files += [("c#main", "/c/part.js", part), ("d#main", "/d/own.js", library(14)), ("e#main", "/e/large.js", library(15, 90) + changed(few, 99))]
    assert vendored(spark, files) == {p for _, p, _ in files} - {"/c/part.js", "/d/own.js"}


@pytest.mark.parametrize("n", [3, 7, 50, 500])
def test_differently_edited_copies_in_any_number(spark, n):
    lib, short = library(40, 40), "\n".join(f"export const short_library_value_{i * i} = compute_the_value_of({i * 31}, 'of a long line that is no idiom {i}');" for i in range(9)) + "\n"
    files = [(f"m{k}#main", f"/m{k}/lib.js", changed(lib, k)) for k in range(n)]
    files += [(f"m{k}#main", f"/m{k}/short.js", short.replace(f"value_{(k % 9) ** 2} ", f"renamed_{k} ")) for k in range(min(n, 50))]
    idioms = ["import json", "from pathlib import Path", "    seen = {}", "    return seen", "    total = 0", "    return total", "    for x in rows:"]
    own = [(f"o{k}#main", f"/o{k}/own.py", "\n".join([*idioms, f"def own_{k}(rows):", f"    own_total_{k} = {k}"])) for k in range(20)]
    assert vendored(spark, files + own) == {p for _, p, _ in files}


def test_encoded_text_is_data():
    block = "\n".join("xJ`Ea`v4SE2?xwD<4QK^l9qSIZ#?tpPKiIZD(lp$f`#<LFbshM95q<|jZMu_cSAuYo" for _ in range(9))
    assert provenance.composition(f'PAYLOAD = """\n{block}\n"""\n', "py") == "data"
    assert provenance.composition('"""' + "A docstring of many plain words about the code. " * 9 + '"""\nHELP = """\n' + "usage: tool [options] file, and more words\n" * 9 + '"""\n', "py") is None


def test_copies_of_a_shared_file_that_many_projects_edited(spark):
    lib = library(21)
    files = [("p#main", "/p/lib.js", lib), ("q#main", "/q/lib.js", lib)] + [("p#main", f"/p/edited{k}.js", changed(lib, k)) for k in range(30)]
    assert vendored(spark, [*files, ("r#main", "/r/own.js", library(22))]) == {p for _, p, _ in files}
