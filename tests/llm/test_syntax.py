"""Valid and broken texts of every language, one a line; a line in a body unless it begins with a bar."""

import ast

import pytest

from orrery.llm import syntax

BODY = {
    "go": "package a\n\nfunc f() {\n\t%s\n}\n", "rust": "fn f() {\n    %s\n}\n", "javascript": "function f() {\n  %s\n}\n", "typescript": "async function f(): Promise<void> {\n  %s\n}\n",
    "python": "def f():\n    %s\n",
}
WHOLE = {"go": "package a\n\n%s\n"}

VALID = {
    "go": r"""
x := 1
var a, b int = 1, 2
for i := 0; i < 3; i++ { continue }
outer:\n\tfor {\n\t\tfor { continue outer }\n\t}
loop:\n\tfor range xs { break loop }
goto end\nend:
if x := g(); x != nil { return }
if a { } else if b { } else { }
switch x := y.(type) {\n\tcase int, string:\n\t\treturn\n\tdefault:\n\t}
switch { case a > b: fallthrough; default: }
select { case v, ok := <-ch: _ = v; case ch <- 1: default: }
go func() { }()
defer mu.Unlock()
m := map[string][]int{"a": {1, 2}, "b": nil}
p := &T{A: 1, B: []string{"x",},}
f := func(a, b int, c ...string) (x int, err error) { return }
s := a[1:2:3]
xs = append(xs[:i], xs[i+1:]...)
var q = T[int]{}
y := f[int](1)
ch <- <-other
a, b = b, a
x.y.z++
if !ok && (a || b) { return }
var r = []struct{ A, B int }{{1, 2}, {3, 4}}
v := x.(interface{ Foo() })
c := (<-chan int)(nil)
for k, v := range m { _ = k }
for range 10 { }
if (T{1}) == t { }
x := a.b(c)(d)[e].f
x := *p * *q
x &^= 1 << 3
for ; ; { break }
var fn func(int) func() error
return a == 0 && a0 == 0 && a1 == 0 && a2 == 0 && a3 == 0 && a4 == 0 && a5 == 0
type t struct { a int `json:"a"`; *B; c.D }
const ( a = iota; b; c )
_ = `raw {{ ( "`
|type A[T any, U ~int | ~string] struct { x T }
|type I interface { comparable; ~int | string; Foo(a, b int) (c error) }
|func (r *R[T]) M() (n int, _ error) { return }
|import ( f "fmt"; . "os"; _ "x" )
|type F func(a int, b ...string) chan<- int
|var ( x = 1; y, z int )
|type A = map[string]func() []byte
|func g() (<-chan int, error)
""",
    "rust": r"""
let x: Vec<Vec<u8>> = Vec::new();
let (a, mut b) = (1, 2.0f32);
if let Some(x) = y && z > 1 { }
let Some(x) = y else { return };
while let Some(x) = it.next() { continue; }
'outer: for i in 0..n { break 'outer; }
let v = loop { break 5; };
match x { 1 | 2 => {}, 3..=5 => a(), Some(y) if y > 1 => b, _ => { } }
let f = |a: &str, b| -> usize { 1 };
let g = move || x + 1;
x.0.1.foo::<T>()?.bar[1..].await;
let s = S { a, b: 1, ..Default::default() };
let t = <T as Trait<U>>::new();
let u = <<A as B>::C as D>::e();
a >>= 1; b >= c; d >> 2;
let r = &mut *x;
println!("{}", x);
let c = 'a'; let l: &'static str = "x";
unsafe { *p = 1 }
let z = if a { 1 } else { 2 };
return;
let arr = [[0u8; 4]; 2];
let n = -x as i64 as usize;
let r = r#"a "quoted" b"#;
let x = x.iter().map(|&(a, ref b)| a).collect::<Vec<_>>();
if x == (S { a: 1 }) { }
let ..= 5 = x;
let y = ..; let z = a..; let w = ..=b;
for (i, x) in xs.iter().enumerate() { }
async move { f().await };
let b: Box<dyn Fn(u8) -> u8 + Send + 'static> = c;
vec![1, 2, 3].len();
match x { A { b, .. } => 1, &[a, .., c] => 2, "x" => 3, -1 => 4, C::D(_) => 5 };
let _ = a.b.c;
if a { 1 } else { 2 };
const N: usize = 3; static mut M: u8 = 0;
x = y = z;
let p: *const u8 = &raw const q;
m! { anything => goes here }
let f: fn(a: u8, ...) -> u8 = g;
#[allow(x)] let y = 1;
|pub(crate) struct A<'a, T: 'a + Clone, const N: usize = 3>(pub &'a T, [T; N]) where T: Copy;
|impl<T> !Send for A<T> {}
|pub trait A: B + for<'a> C<&'a u8> { type X: D; const Y: u8 = 1; fn f(&self); fn g(self: Box<Self>) {} }
|use a::{b, c::{self, d as e}, f::*};
|macro_rules! m { ($a:expr) => { $a }; }
|#![allow(x)]\n#[derive(A)]\nenum E { A = 1, B(u8), C { x: u8 } }
|extern "C" { fn f(a: i32, ...); static X: u8; }
|pub const unsafe extern "C" fn f() {}
|mod a { pub mod b; pub fn c() {} }
|type A<T> = Result<T, Box<dyn Error>>;
|impl<T> A<T> where T: B { pub async fn f<'a>(&'a mut self, mut x: impl C + 'a) -> impl D { x } }
|union U { a: u8, b: u16 }
""",
    "javascript": r"""
let x = 1, { a, b: [c = 2, ...d], ...e } = y;
outer: for (;;) { for (;;) { continue outer; } }
loop: while (x) { break loop }
for (const [k, v] of m) if (k) continue; else break
for (let i = 0, n = 3; i < n; i++) {}
for (x in y) ;
do x++; while (x < 3) y()
switch (x) { case 1: case 2: f(); break; default: g() }
try { f() } catch { g() } finally { h() }
const f = async (a, { b }, [c], ...d) => ({ a, b })
const g = x => y => z
x = a ? b : c ? d : e
x = a ?? b?.c?.[d]?.(e)
x ||= y **= 2
const o = { a, 'b': 1, [c]: 2, get d() { return 1 }, set d(v) {}, async *e() {}, get: 1, async: 2, if: 3 }
class A extends (b, C) { #p = 1; static s; static { f() } get x() { return this.#p } async *g() {} 'q'() {} [z] = 1; constructor() { super() } }
new A; new B(1).c(); new (f())(); new a.b.c()
x = `a ${b + `c ${d}`} e`
x = tag`y`
const r = /[/\]]+/gi.test(s)
x = a / b / c
throw new Error('x')
if (a) return; else return 1
var let_ = 1, of = 2, async = 3, get = 4
async()
x = function* () { yield; yield* a; yield b }
x = class {}
({ a, b } = c);
[a, b] = [b, a]
x = +a - -b + ++c - d--
x = typeof void delete a.b
x = a in b && c instanceof d
x = a >>> 1 >= b >> 2
label: { break label }
debugger
x = (a, b)
x = !function () {}()
x = async function () { for await (const a of b) await a }
x = a => { return }
x = a.if.class.new
x = 0x1f + 1_000 + 1e-3 + .5 + 10n
|import a, { b as c, default as d } from 'x'
|import * as ns from "y"; import 'z'
|export default function () {}
|export default class extends A {}
|export { a as b, c }; export * from 'x'; export * as d from 'y'
|export const [q] = [1], { w } = z
|const m = await import('x'); import.meta.url
|export async function* f() {}
""",
    "typescript": r"""
let x: number | undefined, y!: string
const a = <T,>(x: T): x is string => true
const b = x as unknown as Map<string, Array<number>>
const c = x! .y!.z
outer: for (const a of b) { continue outer }
const f = (a?: string, ...b: any[]): ((x: number) => void) => (x) => {}
const g = a ? (b) : (c)
const h = a ? (b): c => d : e
let t: [a: string, b?: number, ...c: boolean[]]
let u: { readonly [K in keyof T]?: T[K] } & { a(): void; b?: string; new (x: number): Y; [key: string]: any }
let v: A extends infer U extends string ? U : never
let w: typeof a.b | keyof C | unique symbol
let z: new (...a: any[]) => T
let q: `a${string}b`
const s = x satisfies Y
const e = <const>["a"]
const k = f<string>(x)
const n = new Map<string, () => void>()
if (a < b && c > d) return
const i: import("x").Y<Z> = j
class A<T> extends B<T> implements C, D { private readonly a?: string = ''; constructor(public b: number, @Inject() private c?: D) { super() } abstract: string; static #d = 1; declare e: F; get f(): number { return 1 } [k: string]: any; m?(): void }
function isA(this: Window, x: unknown): asserts x is A {}
let o: (A | B)[] = [], p: A[][]
type Q<T = string> = { [P in T as `x${P}`]-?: T[P] }
interface I<T> extends J, K<T> { (x: number): string; readonly a: T; get b(): c }
enum E { A, B = 'x', C = 1 << 2, 'D' }
const enum F { A }
abstract class G { protected abstract x(): void; abstract y: string }
for (const x of y as Z[]) {}
x = y as any
await using r = z()
let type = 1; type = 2
let fn: <T>(x: T) => T
let big: -1 | 2n | true | null | void
const obj = { a<T>(x: T) { return x }, async b(): Promise<void> {} }
try {} catch (e: unknown) {}
let opt = a?.b!.c
return void 0
type R = A extends B ? C : D
let idx: T['a']['b'][number]
@dec({ a: 1 }) class H { @x() y() {} }
|import type { A } from './a'; import { type B, C } from './b'
|export type { D } from './d'
|declare module 'x' { export const a: string; export default function f(): void }
|declare global { interface Window { a: string } }
|namespace A.B { export namespace C { export const x = 1 } }
|import x = require('y'); export = x
|export declare function f(a: string): void; declare const g: number
|function over(a: string): void; function over(a: number): void; function over(a: any) {}
|export default interface L {}
|export abstract class M {}
""",
    "python": r"""
x: int = 5
x = y = z
a, *b = c
(a, b), [c, d] = e
x += yield
x = yield from y
return *a, b
lambda a, /, b=1, *c, d, **e: a
[x for x in y if z for w in v]
{**a, 'b': 1}
{*a, b}
x = a if b else c
f(*a, b, c=1, *d, **e)
f(x for x in y)
x[1:2, ::3, ...]
async with a as b, c: pass
with (a as b, c as d): pass
for x, in y: pass
try: pass\n    except* A as e: pass\n    else: pass\n    finally: pass
while (x := f()): break
if not a is not b: pass
assert a, b
del a.b, c[0]
raise A from b
global x
import a.b as c, d
from .. import e
from .f import (g, h as i,)
match x:\n        case {'a': [1, *_], **r} if y: pass\n        case A(b=1) | None: pass
match = 1; match[x]; match(x)
type X[T] = list[T]
print(f'{a!r:>{w}} {b["c"]} {{}}')
x = r'\d' 'b' if 0 else b''
x = 'a' "b" f'c'
x = 0x1f + 1_000 + 1e-3j + .5
x = a @ b // c ** -d
x = not a
x = (yield)
return
@a.b(c)\n    async def g(): await h
class A(B, metaclass=C): x = 1
x = '''a\nb'''
|@dec\nclass A[T: int]:\n    pass
|def f[T](a: int, *, b: str = 'x', **c) -> None: ...
|if a:\n  pass\nelif b:\n  pass\nelse:\n  pass
|x = (1,\n  2)\n\ny = \\\n 3
|async def f():\n    async for x in y:\n        pass\n    else:\n        pass
""",
}

BROKEN = {
    "go": r"""
if a { } else if { }
x := 
let x = 3
a b
foo(a b)
x = 'ab'
for i := 0; i < 3 { }
for a; b; c; d { }
var = 3
if x := 1 { }
x + := 2
return return
func g() { }
case 1: x()
switch x { y() }
f(a, , b)
f(a,\n\t\tb\n\t)
x := []int{1, 2\n\t}
x := a[]
x ? y : z
while x { }
a.b.:= 3
5 := x
x = = 3
go x
"a" = 3
map[string] = 3
if (a { }
x := func { }
import "x"
type T struct { a int b }
break 5
x++ + 1
else { }
x := a..b
@@ -1,2 +3,4 @@
<<<<<<< HEAD
const x
y := "open
var x [3 int
for range { }
|func (f) { }
|func f() { }\n\nimport "x"
|x := 3
|func f(a int b int) { }
|package b
|type = int
|func f() { }}
|var x = `open
|type I interface { Foo(a int { }
""",
    "rust": r"""
let x = 3 let y = 4;
let = 3;
let x: = 3;
x = ;
foo(a b);
x.1.;
let v: Vec<u8 = x;
if { 1 } else { 2 }
while { }
match x { 1 => }
match x { 1 2 => {} }
let x = [1, 2;
let x = 'ab;
for x xs { }
fn { }
struct { }
a = = b;
a + * / b;
let mut = 3;
return let x;
f(a,, b);
x.;
::;
let s = S { a: };
let f = |a b| c;
if a { } else b
loop x { }
let (a, b = c;
impl { }
x as ;
&mut;
let x = y else { };z w
break 'a 'b;
let r = r#"open;
/* open
@@ -1,2 +3,4 @@
<<<<<<< HEAD
def f(): pass
use a::;
const x = 3;
#[a]
|let x = 3;
|fn f(a) {}
|fn f(a: u8 b: u8) {}
|struct A { a u8 }
|enum E { A B }
|pub pub fn f() {}
|impl A for { }
|func f() {}
|mod 3 {}
|trait A { x: u8 }
""",
    "javascript": r"""
const x
const x = ;
let let = 1
let x y
a b c
foo(1 2)
foo(a,, b)
if x { }
for (;;;) {}
for (a; b) {}
await x = 1
f() = 1
1 = x
a + b = c
x = { a: }
x = { a b }
x = [1, 2
x = (1, 2
x => { => y
function (a) {}
class { x }
class A implements B {}
class A { x y }
try { }
try { } catch (e { }
switch (x) { y }
return return
else { }
x = a ? b
var x = 'open
`a ${b
/* open
x = /a/gg
throw
new
x.
x..y
interface A { }
let y: number = 1
function g(a: string) {}
enum E { A }
x = y as z
async function { }
import x from 'y'
export const z = 1
case 1: x
x = #y
@@ -1,2 +3,4 @@
>>>>>>> topic
|return 5
|import { a from 'x'
|import a b from 'x'
|export default
|export { a
|def f():\n    pass
|function f(a, ) { } }
""",
    "typescript": r"""
const x: = 1
let x: number string
let x: Map<string = y
const = 3
x = = 3
foo(a b)
type A = 
type = 3; type A
interface A { b: }
interface { a: string }
enum { A }
enum E { A B }
class { x }
class A { private }}
class A extends { }
let f: (a: string = > b
let t: [a, b
x as
x!! = = 1
function g(a: ) {}
function (a) {}
let x: keyof
let u: A |
let c: A extends B ? C
for (const x: of y) {}
return return
if x { }
let “x” = ‘y’
const x
f(<string x)
let y: { a: string b: number }
let z: { [K in ]: T }
switch (x) { y }
try { }
x = a ? b
const a = (b: string => c
const b = <T(x: T) => x
import x from 'y'
@dec
x = { a: 1 b: 2 }
@@ -1,2 +3,4 @@
<<<<<<< HEAD
|namespace { }
|declare module 'x' {
|export type { A from 'x'
|import type from
|export default
|fn main() {}
|package main
|return 5
""",
    "python": r"""
x = 
x = = 3
a b
f(a b)
f(a=1, b)
f(**a, *b)
def g() pass
def g(a=1, b): pass
def g(*): pass
def g(a, a b): pass
if a
if a: pass else: pass
else: pass
for x y: pass
while : pass
try: pass
try: pass\n    finally: pass\n    except: pass
x = [1, 2
x = (1, 2]
x = 'open
x = '''open
f() = 1
1 = x
a + b = c
x + 1 += 2
import
import a.
from a import
from import b
class : pass
class = 3
lambda a b: c
[x for x]
[x for x in y, 1]
{a: b, c}
x = a if b
x[]
not
print 'a'
exec 'x' in y
x = 5a
x = 0777
x = '\x1'
x = f'{'
x = f'{a b}'
x = f'{}'
@dec
x++
x && y
!x
return return
raise a, b
except a, b: pass
del f()
with a as: pass
async x
x = y; ; z
case 1: pass
<<<<<<< HEAD
@@ -1,2 +3,4 @@
|def f():\npass
|def f():\n    x\n      y
|def f():\n    x\n  y
|  x = 1
|if a:\n    b\n\tc
|match x:\n    y
|@dec\nx = 1
|package main
|function f() { }
""",
}


def texts(table, language):
    for line in table[language].strip("\n").split("\n"):
        own = line.replace("\\n", "\n").replace("\\t", "\t") if language != "python" else line.replace("\\n", "\n").replace("\\t", "\t").replace("\\\\", "\\")
        yield WHOLE.get(language, "%s\n").replace("%s", own[1:]) if own.startswith("|") else BODY[language].replace("%s", own)


@pytest.mark.parametrize("language", BODY)
def test_valid(language):
    wrong = [(t, f) for t in texts(VALID, language) if (f := syntax.fault_of(t, language))]
    assert not wrong and len(list(texts(VALID, language))) >= 40


@pytest.mark.parametrize("language", BODY)
def test_broken(language):
    missed = [t for t in texts(BROKEN, language) if not syntax.fault_of(t, language)]
    assert not missed and len(list(texts(BROKEN, language))) >= 40


def test_python_agrees_with_the_interpreter():
    from orrery.llm import syntax_python
    from orrery.sources import lexing

    def parses(text):
        try:
            ast.parse(text)
            return True
        except SyntaxError:
            return False

    for table in (VALID, BROKEN):
        for text in texts(table, "python"):
            assert (syntax_python.fault_of(lexing.scan(text, "python")) is None) == parses(text), text


@pytest.mark.parametrize("language", BODY)
def test_cut_texts(language):
    """A text that ends anywhere within a bracket is broken; no reader fails on any cut."""
    from orrery.sources import lexing

    for text in texts(VALID, language):
        source = lexing.scan(text, language)
        for i in range(len(source.kinds)):
            part = text[: source.starts[i]]
            found = syntax.fault_of(part, language)
            if lexing.scan(part, language).fault:
                assert found is not None, part


def test_long_heads():
    """Nothing is looked back for over a number of tokens."""
    terms = " && ".join(f"a{i} == b{i}" for i in range(400))
    assert syntax.fault_of(f"package a\nfunc f() {{\n\tif {terms} {{\n\t\treturn\n\t}}\n}}\n", "go") is None
    parameters = ", ".join(f"a{i}: u8" for i in range(400))
    assert syntax.fault_of(f"fn f({parameters}) -> u8 {{\n    let x = 1;\n    x\n}}\n", "rust") is None
    assert syntax.fault_of(f"if ({terms}) {{ f() }}\n", "javascript") is None


def test_deep_texts():
    """Levels are read as deep as they go, and a fault at the bottom of many is found at once."""
    with syntax.quiet():
        for n in (3000,):
            assert syntax.fault_of("x = " + "(" * n + "1" + ")" * n, "javascript") is None
            assert syntax.fault_of("x = " + "(" * n + "1 2" + ")" * n, "javascript")
            assert syntax.fault_of("package a\nvar x = " + "(" * n + "1" + ")" * n + "\n", "go") is None
            assert syntax.fault_of("const X: u8 = " + "(" * n + "1" + ")" * n + ";", "rust") is None
        for language, text in {
            "typescript": "x = " + "a ? " * 200 + "b c" + " : d" * 200, "rust": "fn f() { " + "if a { " * 200 + "b c" + " }.d()" * 200 + " }",
            "javascript": "x = " + "[a ? (" * 200 + "b c" + ") : d]" * 200,
        }.items():
            assert syntax.fault_of(text, language)
            assert syntax.fault_of(text.replace("b c", "b"), language) is None, language
