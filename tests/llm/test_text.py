import pytest

from orrery.llm import declarations, handwritten, langid, pairs, prose, syntax
from orrery.sources import lexing

VALID = {
    "rust": [
        "fn a<'a>(x: &'a str, y: &'static mut Foo) -> &'a str { x }",
        "pub(crate) fn f() -> Result<(), Box<dyn Error>> { if x { 1 } else { 2 }; Ok(()) }",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nfn main() { println!(\"{}\", 1); let v = vec![1, 2]; let a = [0; 4]; match x { 1 | 2 => {}, n if n > 3 => 4, _ => return, } }",
        "use std::{a, b::c};\nstatic A: &str = \"x\";\n#[derive(Debug)]\nstruct S(u8, pub u16);\nenum E { A = 1, B(u8), C { x: i32 } }",
        "fn f() { let s = r#\"a \"{ b\"#; let c = '{'; /* a /* nested */ b */ let d = b'x'; }",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n)\n\ntype S struct {\n\tA int `json:\"a\"`\n\t*B\n}\n\ntype I interface {\n\tFoo(a int) (b error)\n}\n\nfunc (s *S) F(a, b int, c ...string) (x int, err error) {\n\tif x := f(); x != nil {\n\t\treturn 1, nil\n\t}\n\ty := S{A: 1}\n\tz := map[string]int{\"a\": 1}\n\tselect {\n\tcase v := <-ch:\n\t}\n\treturn\n}\n",
        "package main\n\nfunc Map[T any, U any](xs []T, f func(T) U) []U {\n\treturn nil\n}\n\nvar s = `\n<<<<<<< HEAD\n{{ ( [\n`\n",
    ],
    "typescript": [
        "type A<T> = { [K in keyof T]?: T[K] } & B | C;\nabstract class C<T> extends D<T> implements I {\n  private readonly x: Map<string, number[]> = new Map();\n  @dec() foo?: () => void;\n  static async *gen(): AsyncGenerator<number> { yield* other(); }\n}\nconst f = async ({ a, b = 2 }: { a: string; b?: number }, ...rest: any[]): Promise<void> => { await x; };\n",
        "const u = `a ${b + `c ${d}`} e`;\nconst r = /a[/{]b/g.test(s) && !(a instanceof B);\nlet v: typeof a | null = null, w!: string;\n",
    ],
    "javascript": [
        "const a = require('a'), { b } = c;\nexport default async function* f(x = 1, { y }, [z]) { for await (const q of x) {}\nif (a) return\n}\nlet x = y\n++z\nx = { 'a': 1, if: 4, get: 5, async foo() {}, *gen() {} }\na?.b?.(c)\n/* <<<<<<< HEAD */\n",
    ],
    "python": ["x = f'{a!r:>{w}}'\nmatch x:\n    case [1, *_]: pass\n", "def f(a, /, *, b: int = 3) -> None: ...\n"],
}
BROKEN = {
    "javascript": ["function f(a: string) {}", "const x = ;", "let y: number = 1", "interface A { }", "foo(1 2)", "if x { }", "class A implements B {}", "function (", "a b c", "var x = 'a\n'", "return [1,", "foo(a,, b)", "x\n<<<<<<< HEAD\ny\n=======\nz\n>>>>>>> b\n", "def f():\n    pass\n", "/* open", "`a ${b"],
    "typescript": ["def f():\n  pass", "package main", "x = = 3", "const = 3", "foo(a b)", "function f(a: string {", "fn main() {}", "<!doctype html>\n<html>", "let “x” = ‘y’"],
    "go": ["package a\nfunc f() {\n\tlet x = 3\n}", "package a\nx := 3", "func f() {}", "package a\nfunc f() {\n\ta b c\n}", "package a\nfunc f() {\n\tx = \n}", "package a\nvar x = 'ab'", "package a\nfunc f() {\n}}"],
    "rust": ["fn f() { let x = 3 let y = 4; }", "const x = 3;", "fn f() { foo(a b) }", "func f() {}", "fn f() { x = ; }", "let x = 3;", "struct { }", "fn f() { '{ }", "package a"],
    "python": ["def f()\n    pass\n", "x = (1,\n", "print 'a'\n", "def f():\n     x\n    y\n", "<<<<<<< HEAD\n"],
}


@pytest.mark.parametrize("language", VALID)
def test_syntax(language):
    for text in VALID[language]:
        assert syntax.fault_of(text, language) is None, text
        assert syntax.fault_of(text.replace("\n", "\r\n"), language) is None, text
    for text in BROKEN[language]:
        assert syntax.fault_of(text, language) is not None, text
    assert syntax.fault_of("", "python") is None


def test_jsx():
    text = "export const A = ({ a }) => (\n  <div className=\"x\" {...p} onClick={() => f({ a: 1 })}>\n    {a && <B />} it's text\n    <></>\n  </div>\n);\n"
    assert syntax.fault_of(text, "javascript", True) is None and syntax.fault_of(text, "javascript") is not None


def test_judged_files(spark):
    rows = [("r/a.py", "r", "x = 1\n", None), ("r/b.py", "r", "x = (\n", ["missing closer before end of file"]), ("r/c.md", "r", "((", None), ("r/d.go", "r", None, None), ("r/e.go", "r", "", []), ("q/f.ts", "q", "﻿let x = 1;\r\n", None)]
    df = spark.createDataFrame(rows, "file_path string, repo string, text string, warnings array<string>")
    judged = syntax.judge_files(df)
    got = {r["file_path"]: (r["valid"], r["language"], r["hinted"]) for r in judged.collect()}
    assert got["r/b.py"] == (False, "python", True) and got["r/c.md"] == (True, None, False) and all(v[0] for k, v in got.items() if k != "r/b.py")
    rate = {(r["repo"], r["language"]): r["invalid_rate"] for r in syntax.rates(judged).collect()}
    assert rate["r", "python"] == 0.5 and rate["q", "typescript"] == 0


DOCS = {
    "a.ts": (
        "/** Collects the pending rows of one table. */\nexport async function one(a: string) {}\n\n"
        "/** Collects the pending rows of one table. */\n\nfunction blank() {}\n"
        "// Reads all of the rows\n// from the cache.\n@dec({ a: 1 })\nexport class K {\n  /** Sends what is left to the peers. */\n  @get('x')\n  private async two(q = { a: 1 }): Promise<void> {\n    // Keeps the inner rows in their order.\n    const three = (x) => { return x; };\n  }\n  /** @inheritDoc */\n  four() {}\n  // Counts how often a peer came back.\n  five = () => 1;\n}\n"
        "const s = `\n/** Collects the pending rows of one table. */\nfunction no() {}\n`;\n// TODO: describe\nfunction six() {}\nfoo(); // Collects the pending rows of one table.\nfunction seven() {}\n",
        {2, 13, 15, 20},
    ),
    "b.py": ('import x\n@dec\nasync def f(a,\n            b=")"):\n    """Moves the rows to the other side."""\ndef g():\n    "g"\ndef h(): "Counts what is left in the queue."\nclass A:\n    def m(self):\n        r\'\'\'\n        Keeps every row\n        in its place.\n        \'\'\'\n    def n(self):\n        # Keeps every row in its place.\n        x = "Keeps every row in its place."\n    def o(self):\n        """:param a:\n        :return:"""\n', {3, 8, 10}),
    "c.go": ("package c\n\n// Load reads the rows of one table again.\nfunc (t *T) Load(a int) error {\n\treturn nil\n}\n\n/*\nnolint:all\n*/\nfunc x() {\n}\n", {4}),
    "d.rs": ("/// Drops the rows that nobody asked for.\n#[inline]\n#[cfg(feature = \"x\")]\npub fn a<'a>(x: &'a str) {}\nimpl S {\n    /** Puts the rows back in order. */\n    pub(crate) async unsafe fn b(&self) {}\n    /// See above.\n    fn c() {}\n}\n", {4, 7}),
}


@pytest.mark.parametrize("path", DOCS)
def test_pairs(path):
    text, want = DOCS[path]
    for variant in (text, "﻿" + text, text.replace("\n", "\r\n")):
        assert {r[1] for r in pairs.pairs_of(path, variant)} == want
    assert pairs.pairs_of(path, text + "\n((") == []
    assert pairs.pairs_of("x.txt", text) == [] and pairs.pairs_of(path, "") == []


@pytest.mark.parametrize("doc", ["", "TODO: describe", "-----", "@param a\n@returns {void}", "See above.", "the load rows function", "Load rows.", ":param a:\n:return:", "rows = load_rows(a);\nload_rows(a, 3)", "eslint-disable-next-line no-shadow", "no docs yet", "# Arguments\n* `a`", "====\nLOAD ROWS\n====", "Autogenerated method stub"])
def test_says_nothing(doc):
    assert not prose.says_something(doc, "load_rows", ("a",))


@pytest.mark.parametrize("doc", ["Keeps the order of all peers.", "排名计算在里面失败，除非调用者传入过滤条件。", "Каждый поток читает настройки заново.", "load_rows sends what the peers asked for.\n@param a see the caller", "@deprecated The newer call keeps its own peers."])
def test_says_something(doc):
    assert prose.says_something(doc, "load_rows", ("a",))


def test_sentences():
    text = "# Overview\n\n- The `x_y` job reads fooBar.go twice now. Nobody knows why!\n> Nous avons mesuré encore une fois.\n\n```go\n// This is no sentence of the text.\n```\nno full stop here\nToo short.\n我们又测量了一次，结果变慢了。谢谢。\n"
    assert len(langid.sentences(text)) == 4
    assert langid.sentences("") == [] and langid.sentences("```\nThis one is never closed at all.") == []


def test_labels():
    codes = langid.label_codes([{"lang": "de", "iso3": "deu", "name_en": "German", "name_native": "Deutsch"}])
    assert [langid.label_language(x, codes) for x in (" DE-at ", "deutsch", "ger_X", None, "", "deu_QX")] == ["de", "de", None, None, None, "de"]


def test_languages_held_out(spark, data):
    from orrery.tables import table

    reference = [r.asDict() for r in table(spark, data, "lang_reference").collect()]
    docs = table(spark, data, "documents").select("doc_id", "text", "lang")
    profiles, codes = langid.fit(docs, reference), langid.label_codes(reference)
    made = [(9001, "Die Warteschlange ist schon wieder voll. Niemand hat das gestern bemerkt.", "en"), (9002, "The queue is already full again. Nobody noticed it yesterday.", None), (9003, "The queue is already full again. Die Warteschlange ist schon wieder voll.", "en"), (9004, "", "en"), (9005, None, "en"), (9006, "`only_code()` here", "zz"), (9007, "The queue is already full again.", "English")]
    found = langid.document_issues(langid.segments(spark.createDataFrame(made, "doc_id bigint, text string, lang string"), profiles, codes)).collect()
    assert {(r["doc_id"], r["issue"], r["lang"]) for r in found} == {(9001, "wrong", "de"), (9002, "missing", "en"), (9003, "mixed", "de"), (9003, "mixed", "en")}
    assert all(0 <= r["confidence"] <= 1 for r in found)
    # Labels are mostly right, so most labelled documents must come out in their label's language.
    known = langid.segments(docs, profiles, codes).filter("label_lang is not null")
    share = known.selectExpr("avg(cast(lang = label_lang as double))").head()[0]
    assert share > 0.8


def test_handwritten_parts():
    assert handwritten.opening_kind("// Code generated by x v1.2. DO NOT EDIT.\n") == "generated"
    assert handwritten.opening_kind("// Ids in this module are generated by the caller.\n// Do not edit the order of the fields below.\n") == ""
    assert handwritten.opening_kind("# This used to be vendored, we now write it by hand.\n") == "own"
    assert handwritten.opening_kind("// some-lib@4.5.6\n") == "foreign"
    assert handwritten.shape("x = [" + "1, 2, 3, " * 200 + "]")[0] == "data"
    assert handwritten.shape("!function(a,b){" + "var c=a+b;if(c&&!b.x)for(var d=0;d<9;d++)a[d]=c;" * 30 + "}")[0] == "minified"
    assert handwritten.shape("def f(a):\n    return a\n" * 40 + "blob = '" + "ab " * 2000 + "'")[0] == ""
    assert handwritten.opening_end("// a\n\n/* b\n c */\nx") == len("// a\n\n/* b\n c */\n")


def test_handwritten_files(spark):
    import random

    rng, rows = random.Random(1), []
    words = "load store merge split count read write drop".split()
    for r in range(12):
        for k in range(12):
            body = "".join(f"def {rng.choice(words)}_{i}(a):\n    if a:\n        return {rng.choice(words)}(a)\n    raise ValueError(a)\n\n" for i in range(8))
            rows.append((f"r{r}/src/m{k}.py", f"r{r}", body))
        table = "".join(f"class Row{i}Message:\n    FIELD_{i} = {i}\n    NUMBER_{i} = {i * 7}\n\n" for i in range(rng.randrange(20, 30)))
        rows.append((f"r{r}/src/a_pb2.py", f"r{r}", "# Code generated by maker v1. DO NOT EDIT.\n" + table))
        rows.append((f"r{r}/gen/b_pb2.py", f"r{r}", table.replace("7", "8")))
    rows += [("r0/empty.py", "r0", ""), ("r0/null.py", "r0", None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "file_path string, repo string, text string, ignore_extra array<string>")
    verdicts, report = handwritten.judge(df)
    got = {r["file_path"]: r["foreign"] for r in verdicts.collect()}
    wrong = [p for p, v in got.items() if v != ("_pb2" in p)]
    assert len(got) == len(rows) and len(wrong) <= 2, wrong
    assert report["accuracy"] > 0.9
    assert handwritten.judge(df.limit(0))[0].count() == 0


def test_declarations_know_their_names():
    found = declarations.declarations(lexing.scan("export const f = async (a: string, b = 1): Promise<void> => {};\nclass A { static get x(): number { return 1 } }\n", "typescript"))
    assert [d.name for d in found] == ["f"] or [d.name for d in found] == ["f", "x"]
    assert {"a", "b"} <= set(found[0].parameters)
