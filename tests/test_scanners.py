import pytest

from loomspark.plans import code_queries, samples  # noqa: F401
from loomspark.plans.catalog import oracle_sql, queries
from loomspark.plans.scanners import scan

EXTRACTS = sorted(n for n in queries() if n.startswith("extract_"))


@pytest.mark.parametrize("name", EXTRACTS)
def test_sample_files_give_the_expected_tables(spark, data, same, name):
    assert len(same(queries()[name](spark, data), oracle_sql()[name])) > 1


def facts(language, text):
    f = scan(language, text.encode())
    return [(s["kind"], s["fqn"]) for s in f.symbols], [(c["caller_fqn"], c["callee_name"]) for c in f.calls]


def test_python_places_of_calls_and_targets():
    symbols, calls = facts("python", "with lock() as held:\n    for n in each():\n        found = n\nx.y = z[0] = 1\n\n\nclass A:\n    try:\n        def m(self): pass\n    finally:\n        w = last()\n\n\ndef f():\n    class B:\n        v = here()\n    return [g(i) for i in h()]\n")
    assert symbols == [("variable", "found"), ("class", "A"), ("method", "A.m"), ("variable", "A.w"), ("function", "f"), ("class", "f.B"), ("variable", "f.B.v")]
    assert calls == [("<module>", "lock"), ("<module>", "each"), ("<module>", "last"), ("<module>", "here"), ("f", "g"), ("f", "h")]


def test_python_docstrings_are_cut_and_only_first():
    long = "'" + "d" * 700 + "'"
    f = scan("python", f"def a():\n    {long}\n\n\ndef b():\n    x = 1\n    'no'\n".encode())
    assert [len(s["docstring"]) if s["docstring"] else None for s in f.symbols] == [500, None]


def test_python_spans_are_lines_and_bytes():
    text = "é = 1\n\n\ndef ü():\n    return 'ö'\n"
    s = {x["fqn"]: (x["start_line"], x["end_line"], text.encode()[x["start_byte"] : x["end_byte"]].decode()) for x in scan("python", text.encode()).symbols}
    assert s == {"é": (1, 1, "é = 1"), "ü": (4, 5, "def ü():\n    return 'ö'")}


def test_broken_python_still_names_what_starts_a_line():
    f = scan("python", samples.SOURCES["bad/open.py"].encode())
    assert [(s["kind"], s["fqn"], s["start_line"]) for s in f.symbols] == [("class", "Half", 1), ("function", "broken", 4)] and f.errors == 1


def test_typescript_comments_strings_and_nested_functions():
    symbols, calls = facts("typescript", "// class No {}\nconst s = `func(${x})`, re = 'call()';\nexport default function outer() {\n  function inner() { return deep(); }\n  /* hidden() */\n  return inner();\n}\n")
    assert symbols == [("variable", "s"), ("variable", "re"), ("function", "outer"), ("function", "outer.inner")]
    assert calls == [("outer.inner", "deep"), ("outer", "inner")]


def test_java_overloads_inner_types_and_enums_without_members():
    symbols, calls = facts("java", "class Lock {\n  enum Side { LEFT, RIGHT }\n  interface Gate { boolean open(); }\n  int a = read(), b;\n  Lock() { }\n  Lock(int n) { a = other(n); }\n}\n")
    assert symbols == [("class", "Lock"), ("enum", "Lock.Side"), ("interface", "Lock.Gate"), ("method", "Lock.Gate.open"), ("variable", "Lock.a"), ("variable", "Lock.b"), ("method", "Lock.Lock"), ("method", "Lock.Lock")]
    assert calls == [("Lock.Lock", "other")]


def test_go_receivers_and_named_types():
    symbols, calls = facts("go", "package p\n\ntype Set map[string]bool\n\nfunc (s *Set) Add(k string) { grow(s) }\n\nfunc (Set) Len() int { return size() }\n\nfunc main() { s := Set{}; s.Add(key()) }\n")
    assert symbols == [("class", "Set"), ("method", "Set.Add"), ("method", "Set.Len"), ("function", "main")]
    assert calls == [("Set.Add", "grow"), ("Set.Len", "size"), ("main", "Add"), ("main", "key")]


@pytest.mark.parametrize("language", ["python", "typescript", "tsx", "javascript", "java", "go"])
def test_odd_input_never_raises(language):
    assert scan(language, b"").errors == 0 and not scan(language, b"").symbols
    for text in (b"\xff\xfe(((", b"}" * 50, b"class", b"\x00", b"import", b"func (", b"'unclosed"):
        assert scan(language, text).errors >= 0
    over = scan(language, b" " * (2 * 1024 * 1024 + 1))
    assert over.errors == 1 and not over.symbols
    assert scan(language, b" " * (2 * 1024 * 1024)).errors == 0


def test_other_languages_give_nothing():
    assert scan("toml", b"[a]") is None and scan(None, b"x") is None
