from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import syntax

GOOD = {
    "python": ["", "x = 1\nasync def f():\n    async for a in b:\n        yield a\n", "def f():\n    for i in x:\n        continue\n    else:\n        return 1\n", "match x:\n    case [1, *_]: pass\n"],
    "json": ['{"a": [1, 2.5e3, null, true]}', '"text"', ' {"a": 1, "a": 2} '],
    "toml": ["a = 1\n[b]\nc = 'd'\n", ""],
    "yaml": ["a: 1\nb:\n  - c\n", "", "x: &a 1\ny: *a\n", "{a: 1}"],
    "javascript": [
        "import a, { b as c } from './x.js';\nexport default class A extends B { static #p = 1; get x() { return this.#p } async *gen() { yield* y } }\n",
        "const f = async ({ a = 1, ...r }, [b, , c]) => ({ ...r, a, [b]: c, d() { return /[/({]x/g.test(a) } })\nlabel: for (const x of y) { continue label }\n",
        "a = b / c / d; if (x) y(); else { z?.[1]?.(2) ?? `t${a + `u${b}`}` }\ndo { i++ } while (i < 3)\nvar x = function () {}\n;[1].map(x => x)\nnew Foo\n",
        "switch (a) { case 1: case 'b': f(); break; default: g() }\ntry { a() } catch { b() } finally { c() }\nfor (;;) { break }\nfor (const k in o) ;\nlet { a } = b, c\n",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D { readonly a?: string; [k: string]: number | null; f(x: T): x is U; new (y: any): A }\ntype X = { [K in keyof Y]?: Y[K] } | (() => void)\nenum E { A = 1, B }\n",
        "export abstract class K<T> implements I { constructor(private readonly a: string, b?: number) { super() } static async m<U>(x: U[]): Promise<U> { return x[0]! as U } protected abstract n(): void; }\n",
        "const f = <T,>(a: T): T => a\nlet x: Array<Map<string, number>> = y as any\nfunction g(a: string): void;\nfunction g(a: any) { return <string>a }\ndeclare module 'm' { export const z: typeof x }\n",
    ],
    "java": [
        "package a.b;\nimport java.util.*;\n@A(x = {1, 2}) public final class C<T extends D & E> extends F<T[]> implements G {\n private static final int[] R = { 1, 2, };\n @Override public <U> U m(final List<? super T> a, int... b) throws X { for (int i = 0, j = 1; i < 3; i++) { a.b(x -> { return (int) y; }, C::new); } return (U) z; }\n}\n",
        "enum E { A(1) { void f() {} }, B; int x = 1 << 2; E() {} }\ninterface I { default void f() { var x = switch (y) { case 1 -> 2; default -> { yield 3; } }; if (o instanceof String s && !s.isEmpty()) try (var r = q()) { } catch (A | B e) { } finally { } } }\nrecord P(int x, String y) { }\n",
    ],
    "bash": [
        "#!/bin/bash\nset -eu\nf() { local a=\"${1:-x}\"; case \"$a\" in a|b) echo one ;; *) return 1 ;; esac; }\nfor i in *.x; do [ -n \"$i\" ] && f \"$(cat <<'E'\nit's (\nE\n)\" || true; done\nwhile read -r l; do :; done < <(ls)\narr=(1 2 \"$x\")\nif [[ $a =~ ^x ]]; then ((i++)); elif ! true; then :; else :; fi > out 2>&1\n",
        "", "# only a remark", "function g {\n  echo $'it\\'s'\n}\n", "cat <<E\n<<<<<<< HEAD\nE\n",
    ],
    "css": ["@media (min-width: 1px) { a > b:hover, .c[d='e'] { color: red; background: url(data:a;b) } }\n@import 'x';\n:root { --a: 1px }\n", "", "@keyframes k { from { top: 0 } 50% { top: 1px } }"],
}
BAD = {
    "python": ["def f(:\n", "print 'x'", "return 1\n", "for x in y:\n    pass\nbreak\n", "def f():\nreturn 1", "x = “a”", "class A:\n    return 1\n", "def f():\n    break\n", "a = [1, 2"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "NaN", '{"a": 1', "name: x"],
    "toml": ["a = \n", "[a]\n[a]\n", "a: 1", "x = 'y"],
    "yaml": ["a: 'x", "a: b: c", "x: *nowhere", "<<<<<<< HEAD\na: 1\n=======\na: 2\n>>>>>>> x\n", "{a: 1"],
    "javascript": ["function f( {", "const = 1;", "f() }", "interface A { b: string }", "const x: string = 'a'", "a b", "if x { }", "/* open", "let s = 'x", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x", "def f(x):\n    return x", "class { }", "return (", "const s = “x”;"],
    "typescript": ["interface { }", "type X = ;", "const x: = 1", "function f(a: ) { }", "class A { b( }", "enum { A }", "public class A { private int x = 1; }"],
    "java": ["class A { void f() { int x = ; } }", "class A { void f() { x(1, ); } }", "class A {", "function f() { }", "class A { } }", "package a\nclass B { }", "class A { void f() { if (x } }", "class A { void f() { return 1 } }", "const = ;"],
    "bash": ["if true; then\n echo", "f() {", "echo 'x", "echo \"x", "done", "for x in a; do echo", "case x in a) b", "function f(a, b) { return; }", "( echo", "echo )", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z\n", "a() b() c"],
    "css": ["a { color: red", "a { } }", "a { color }", "function f() { return 1; }", "/* open", "import os", "a { color: 'x }"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(language, text):
    assert syntax.judge(language, text) is None


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(language, text):
    assert syntax.judge(language, text) is not None


def test_wrong_extension_and_damage():
    html = "<!DOCTYPE html>\n<html><body>\n<h1>No</h1>\n</body>\n</html>\n"
    assert syntax.judge("yaml", html)[::2] == ("other language", "html")
    assert syntax.judge("javascript", "import os\nimport re\n\n\ndef f(x):\n    return None\n")[::2] == ("other language", "python")
    assert syntax.judge("javascript", "name: a\nitems:\n  - b\n  - c\n")[::2] == ("other language", "yaml")
    assert syntax.judge("python", "import os\ndef f(x:\n    return [1, 2\n")[::2] == ("damaged", None)


def test_rates(spark):
    rows = [(1, 1, "a.py", None, "x = 1"), (1, 1, "a.py", None, "x = 1"), (2, 1, "b.py", "Python ", "x = ("), (3, None, "c.json", None, "{"), (4, 1, "d.md", None, "{"), (5, 1, "e.py", None, None)]
    entries = spark.createDataFrame(rows, "entry_id long, repo_id long, path string, language string, content string")
    languages = spark.createDataFrame([("py", "python"), ("python", "python"), ("json", "json"), ("md", "markdown")], "alias string, language string")
    assert {r.entry_id for r in syntax.invalid_entries(entries, languages).collect()} == {2, 3}
    assert {tuple(r) for r in syntax.invalid_rates(entries, languages).collect()} == {(1, "python", 2, 1, 0.5), (None, "json", 1, 1, 1.0)}


@pytest.mark.parametrize(
    ("language", "opening", "middle", "closing", "n"),
    [("json", "[", "", "]", 20_000), ("toml", "[", "", "]", 3000), ("javascript", "[", "", "]", 20_000), ("typescript", "(", "1", ")", 5000), ("java", "(", "1", ")", 5000), ("bash", "$(echo ", "x", ")", 2000), ("css", "@media x {", "a{b:c}", "}", 5000), ("yaml", "[", "", "]", 3000)],
)
def test_deep_nesting_is_judged(language, opening, middle, closing, n):
    before, after = {"toml": ("a = ", "\n"), "javascript": ("x = ", ";\n"), "typescript": ("let x = ", ";\n"), "java": ("class A { int x = ", "; }\n"), "bash": ("echo ", "\n")}.get(language, ("", ""))
    assert syntax.parses(language, before + opening * n + middle + closing * n + after) is None
    assert syntax.parses(language, before + opening * n + middle + closing * (n - 1) + after) is not None


def test_deep_python():
    assert syntax.parses("python", "x = " + "-" * 100_000 + "1\n") is None and syntax.parses("python", "x = " + "-" * 100_000 + "(1\n") is not None


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8), st.integers(0, 60), st.sampled_from(["", "]", "{", ",", "1", '"']))
@settings(max_examples=300, deadline=None)
def test_json_without_recursion(value, at, extra):
    text = json.dumps(value, ensure_ascii=False)
    text = text[: at % (len(text) + 1)] + extra + text[at % (len(text) + 1) :]
    try:
        syntax._json(text)
        valid = True
    except ValueError:
        valid = False
    try:
        syntax.deep_json(text)
        assert valid, text
    except syntax.Invalid:
        assert not valid, text


def test_settings_under_a_script_name():
    text = "services:\n  web:\n    image: ${IMAGE}\n    ports:\n      - ${PORT}\n" + "".join(f"  part{k}:\n    name: ${{NAME{k}}}\n" for k in range(5))
    if syntax.parses("bash", text) is None:
        assert syntax.judge("bash", text)[2] == "yaml"
    assert syntax.judge("yaml", text) is None
