"""Language scanners: a file's text to symbols, calls, imports and inheritance.

Python goes through ``ast`` (with a line-wise fallback for broken files); the languages with braces share a tokenizer and a
table of matching brackets, over which small walkers look for declarations. Scanners never raise.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field

MODULE = "<module>"
MOST_PARSED = 2 * 1024 * 1024


@dataclass
class Facts:
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    inherits: list[dict] = field(default_factory=list)
    errors: int = 0

    def symbol(self, name, kind, scope, span, signature=None, doc=None):
        fqn = f"{scope}.{name}" if scope else name
        self.symbols.append({"fqn": fqn, "name": name, "kind": kind, "signature": signature, "docstring": doc, "parent_fqn": scope, "start_line": span[0], "end_line": span[1], "start_byte": span[2], "end_byte": span[3]})
        return fqn

    def call(self, caller, callee, span):
        self.calls.append({"caller_fqn": caller, "callee_name": callee, "start_line": span[0], "end_line": span[1]})

    def imported(self, module, symbols=(), alias=None):
        self.imports.append({"module": module, "symbols": list(symbols), "alias": alias})

    def inherit(self, sub, base, kind="inherits"):
        self.inherits.append({"subclass_fqn": sub, "base_name": base, "kind": kind})


def scan(language: str | None, content: bytes) -> Facts | None:
    """Facts of a file; None for an unsupported language, an error count and no facts for one that is too large."""
    if language not in WALKERS:
        return None
    if len(content) > MOST_PARSED:
        return Facts(errors=1)
    try:
        return WALKERS[language](content.decode("utf-8", "replace"))
    except Exception:  # noqa: BLE001  a broken file must not end the job
        return Facts(errors=1)


class _Python(ast.NodeVisitor):
    def __init__(self, text: str):
        self.text, self.facts = text, Facts()
        self.lines = text.split("\n")
        raw = [len(x.encode("utf-8", "surrogatepass")) + 1 for x in self.lines]
        self.starts = [0]
        for n in raw:
            self.starts.append(self.starts[-1] + n)
        self.scope: str | None = None
        self.caller, self.in_function, self.in_class = MODULE, False, False

    def span(self, node):
        return node.lineno, node.end_lineno, self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def source(self, node) -> str:
        return ast.get_source_segment(self.text, node) or ""

    def doc(self, node):
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            return self.source(first.value).strip()[:500]
        return None

    def inside(self, nodes, **state):
        kept = {k: getattr(self, k) for k in state}
        self.__dict__.update(state)
        for n in nodes:
            self.visit(n)
        self.__dict__.update(kept)

    def visit_FunctionDef(self, node):
        for d in node.decorator_list:
            self.visit(d)
        head = self.source(node)
        at = head.index("(", head.index(node.name))
        depth, end = 0, at
        for end in range(at, len(head)):
            depth += head[end] in "([{"
            depth -= head[end] in ")]}"
            if not depth:
                break
        kind = "method" if self.in_class else "function"
        fqn = self.facts.symbol(node.name, kind, self.scope, self.span(node), node.name + head[at : end + 1], self.doc(node))
        self.inside(node.body, scope=fqn, caller=fqn, in_function=True, in_class=False)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        for d in node.decorator_list:
            self.visit(d)
        fqn = self.facts.symbol(node.name, "class", self.scope, self.span(node), node.name, self.doc(node))
        for b in node.bases:
            if isinstance(b, (ast.Name, ast.Attribute)):
                self.facts.inherit(fqn, self.source(b))
        self.inside(node.body, scope=fqn, caller=MODULE, in_function=False, in_class=True)

    def visit_Import(self, node):
        for a in node.names:
            self.facts.imported(a.name, alias=a.asname)

    def visit_ImportFrom(self, node):
        if node.module != "__future__":
            self.facts.imported("." * node.level + (node.module or ""), [f"{a.name} as {a.asname}" if a.asname else a.name for a in node.names if a.name != "*"])

    def visit_Assign(self, node):
        for t in node.targets:
            self._target(t, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        self._target(node.target, node)
        self.generic_visit(node)

    def _target(self, target, node):
        if isinstance(target, ast.Name) and not self.in_function:
            self.facts.symbol(target.id, "variable", self.scope, self.span(node))

    def visit_Call(self, node):
        name = node.func.attr if isinstance(node.func, ast.Attribute) else self.source(node.func)
        self.facts.call(self.caller, name, self.span(node))
        self.generic_visit(node)


def _python(text: str) -> Facts:
    walker = _Python(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        facts = Facts(errors=1)
        for i, line in enumerate(text.split("\n"), 1):
            if m := re.match(r"(class|def|async def)\s+([A-Za-z_]\w*)", line):
                facts.symbol(m[2], "class" if m[1] == "class" else "function", None, (i, i, 0, 0), m[2])
        return facts
    for n in tree.body:
        walker.visit(n)
    return walker.facts


_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<p>=>|.)", re.S
)
_PAIRS = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """Tokens without comments, with the index of each bracket's partner."""

    def __init__(self, text: str):
        self.text = text
        breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.kind, self.at, self.end, self.t = [], [], [], []
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "skip":
                self.kind.append(m.lastgroup)
                self.t.append(m[0])
                self.at.append(m.start())
                self.end.append(m.end())
        self.line = [bisect_right(breaks, a - 1) + 1 for a in self.at]
        self.last = [bisect_right(breaks, e - 2) + 1 for e in self.end]
        self.mate: dict[int, int] = {}
        self.errors, stack = 0, []
        for i, x in enumerate(self.t):
            if self.kind[i] == "p" and x in "([{":
                stack.append(i)
            elif self.kind[i] == "p" and x in _PAIRS:
                if stack and self.t[stack[-1]] == _PAIRS[x]:
                    self.mate[i] = stack[-1]
                    self.mate[stack.pop()] = i
                else:
                    self.errors += 1
        self.errors += len(stack)
        self.n = len(self.t)

    def get(self, i):
        return self.t[i] if 0 <= i < self.n else ""

    def is_id(self, i):
        return 0 <= i < self.n and self.kind[i] == "id"

    def span(self, i, j):
        j = min(j, self.n - 1)
        size = lambda k: len(self.text[:k].encode("utf-8", "surrogatepass"))
        return self.line[i], self.last[j], size(self.at[i]), size(self.end[j])

    def source(self, i, j):
        return self.text[self.at[i] : self.end[j]]

    def close(self, i):
        return self.mate.get(i, self.n - 1)

    def find(self, i, wanted, stop=()):
        """The next token of ``wanted`` outside of brackets that open after ``i``; ``stop`` ends the search."""
        while i < self.n:
            x = self.t[i]
            if self.kind[i] == "p" or self.kind[i] == "id":
                if x in wanted:
                    return i
                if x in stop:
                    return -1
            i = self.close(i) + 1 if self.kind[i] == "p" and x in "([{" else i + 1
        return -1


_TS_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "new", "await", "super", "import", "in", "of", "else", "do", "throw", "case", "void", "delete", "yield", "instanceof"}


class _TypeScript:
    def __init__(self, text: str):
        self.k, self.facts = Tokens(text), Facts()
        self.facts.errors = self.k.errors

    def statements(self, i, end, scope, caller, in_function):
        k, f = self.k, self.facts
        while i < end:
            x = k.t[i] if k.kind[i] in ("id", "p") else ""
            member = k.get(i - 1) == "."
            if x == "import" and not member and k.get(i + 1) != "(":
                i = self.imported(i)
            elif x == "function" and not member:
                name = i + 1 + (k.get(i + 1) == "*")
                i = self.function(i, name, scope, "function") if k.is_id(name) and k.get(k.find(name + 1, "(")) == "(" else i + 1
            elif x == "class" and k.is_id(i + 1) and not member:
                i = self.klass(i, scope, k.get(i - 1) == "abstract")
            elif x in ("interface", "enum") and k.is_id(i + 1) and not member and k.get(k.find(i + 2, "{", (";",))) == "{":
                stop = k.close(k.find(i + 2, "{"))
                f.symbol(k.t[i + 1], x, scope, k.span(i, stop), k.t[i + 1])
                i = stop + 1
            elif x == "type" and k.is_id(i + 1) and k.get(i + 2) in ("=", "<") and not member:
                stop = k.find(i + 2, ";")
                stop = stop if stop >= 0 else self.line_end(i + 2, end)
                f.symbol(k.t[i + 1], "type", scope, k.span(i, stop), k.t[i + 1])
                i = stop + 1
            elif x in ("const", "let", "var") and not member:
                i = self.declaration(i + 1, end, scope, caller, in_function)
            else:
                self.maybe_call(i, caller)
                i += 1

    def line_end(self, i, end):
        k = self.k
        while i + 1 < end and (k.line[i + 1] == k.last[i] or k.t[i + 1] in "|&"):
            i = k.close(i) if k.t[i] in "([{" and k.kind[i] == "p" else i + 1
        return i

    def maybe_call(self, i, caller):
        k = self.k
        if not k.is_id(i) or k.t[i] in _TS_WORDS and k.get(i - 1) != ".":
            return
        j = i + 1
        if k.get(j) == "?" and k.get(j + 1) == "." and k.get(j + 2) == "(":
            j += 2
        if k.get(j) == "(" and k.get(i - 1) not in ("new", "function"):
            b = i
            while k.get(b - 1) == ".":
                b -= 2
            if k.get(b - 1) != "new":
                self.facts.call(caller, k.t[i], k.span(i, k.close(j)))

    def function(self, i, name, scope, kind):
        k = self.k
        opened = k.find(name + 1, "(")
        closed = k.close(opened)
        body = k.find(closed + 1, "{", (";",))
        if k.get(closed + 1) == ":" and k.get(closed + 2) == "{":  # an object type before the body
            body = k.find(k.close(closed + 2) + 1, "{", (";",))
        stop = k.close(body) if body >= 0 else closed
        fqn = self.facts.symbol(k.t[name], kind, scope, k.span(i, stop), k.t[name] + k.source(opened, closed))
        if body >= 0:
            self.statements(body + 1, stop, fqn, fqn, True)
        return stop + 1

    def klass(self, i, scope, abstract):
        k, f = self.k, self.facts
        body = k.find(i + 2, "{")
        if body < 0:
            return i + 1
        stop = k.close(body)
        fqn = scope if abstract else f.symbol(k.t[i + 1], "class", scope, k.span(i, stop), k.t[i + 1])
        if not abstract:
            j, kind = i + 2, None
            while j < body:
                if k.t[j] in ("extends", "implements"):
                    kind = "inherits" if k.t[j] == "extends" else "implements"
                    j += 1
                    continue
                if kind and k.is_id(j):
                    start = j
                    while k.get(j + 1) == "." and k.is_id(j + 2):
                        j += 2
                    if k.get(j + 1) == "<":
                        depth = 0
                        while j + 1 < body:
                            j += 1
                            depth += (k.t[j] == "<") - (k.t[j] == ">")
                            if not depth:
                                break
                    f.inherit(fqn, k.source(start, j), kind)
                j += 1
        self.members(body + 1, stop, fqn)
        return stop + 1

    def members(self, i, end, scope):
        k = self.k
        while i < end:
            if k.is_id(i) and k.get(i + 1) in ("(", "<") and k.get(i - 1) not in (".", "=", "new", "@") and not (k.get(i - 1) == ":"):
                opened = k.find(i + 1, "(", (";", "=", "{"))
                if opened >= 0:
                    closed = k.close(opened)
                    body = k.find(closed + 1, "{", (";", "}"))
                    if body >= 0:
                        i = self.function(i, i, scope, "method")
                        continue
                    i = closed + 1
                    continue
            if k.get(i) == "=" and k.get(i - 1) not in ("=", "!", "<", ">"):
                stop = k.find(i + 1, (";",))
                stop = min(stop if stop >= 0 else end, end)
                stop = min(stop, self.line_end(i, end) + 1)
                self.statements(i + 1, max(stop, i + 1), scope, MODULE, False)
                i = max(stop, i + 1)
                continue
            i = k.close(i) + 1 if k.get(i) in ("{", "(", "[") and k.kind[i] == "p" else i + 1

    def declaration(self, i, end, scope, caller, in_function):
        k, f = self.k, self.facts
        while i < end:
            named, start = k.is_id(i), i
            if k.get(i) in ("{", "["):  # destructured: skipped with its initializer
                i = k.close(i)
            eq = k.find(i + 1, ("=", ",", ";"), ("of", "in"))
            has_value = eq >= 0 and k.t[eq] == "=" and (k.line[eq] - k.last[i] <= 2)
            if not has_value:
                if named and not in_function:
                    f.symbol(k.t[start], "variable", scope, k.span(start, start))
                i += 1
                if eq >= 0 and eq < end and k.t[eq] == "," and k.line[eq] == k.line[start]:
                    i = eq + 1
                    continue
                return i
            v, stop = eq + 1, eq + 1
            while stop < end:
                x = k.t[stop]
                if k.kind[stop] == "p" and x in ("(", "[", "{"):
                    stop = k.close(stop)
                elif k.kind[stop] == "p" and x in (",", ";"):
                    break
                if stop + 1 < end and k.line[stop + 1] > k.last[stop] and k.t[stop] not in ("=", "=>", "+", "-", "*", "&", "|", "?", ":", ".", "(") and k.t[stop + 1] not in (".", "?", ":", "+", "-", "*", "&", "|", "=", "=>", ",", ";"):
                    stop += 1
                    break
                stop += 1
            if named:
                self.value(start, v, stop, scope, caller, in_function)
            if stop < end and k.t[stop] == ",":
                i = stop + 1
                continue
            return stop + (stop < end and k.t[stop] == ";")
        return i

    def value(self, name, v, stop, scope, caller, in_function):
        k, f = self.k, self.facts
        j = v + (k.get(v) == "async")
        arrow = -1
        if k.get(j) == "(":
            opened, closed = j, k.close(j)
            arrow = k.find(closed + 1, ("=>",), (";", ",", "{", "."))
        elif k.is_id(j) and k.get(j + 1) == "=>":
            opened, closed, arrow = j, j, j + 1
        if 0 <= arrow < stop:
            fqn = f.symbol(k.t[name], "function", scope, k.span(name, stop - 1), k.t[name] + (k.source(opened, closed) if k.t[opened] == "(" else ""))
            self.statements(arrow + 1, stop, fqn, fqn, True)
        elif k.get(j) == "function":
            opened = k.find(j + 1, ("(",))
            fqn = f.symbol(k.t[name], "function", scope, k.span(name, stop - 1), k.t[name] + k.source(opened, k.close(opened)))
            self.statements(k.close(opened) + 1, stop, fqn, fqn, True)
        else:
            if not in_function:
                f.symbol(k.t[name], "variable", scope, k.span(name, stop - 1))
            self.statements(v, stop, scope, caller, in_function)

    def imported(self, i):
        k = self.k
        j, names, alias = i + 1, [], None
        while j < k.n and k.kind[j] != "str" and k.t[j] != ";":
            if k.t[j] == "{":
                stop = k.close(j)
                names += [k.t[x] for x in range(j + 1, stop) if k.is_id(x) and k.t[x - 1] in ("{", ",", "type") and not (k.t[x] == "type" and k.is_id(x + 1) and k.t[x + 1] != "as")]
                j = stop
            elif k.t[j] == "*" and k.get(j + 1) == "as":
                alias = k.get(j + 2)
                j += 2
            elif k.is_id(j) and k.t[j] not in ("from", "type"):
                names.insert(0, k.t[j])
            j += 1
        self.facts.imported(k.get(j).strip("'\"") if j < k.n and k.kind[j] == "str" else "", names, alias)
        return j + 1

    def run(self):
        self.statements(0, self.k.n, None, MODULE, False)
        return self.facts


_JAVA_WORDS = {"if", "for", "while", "switch", "catch", "return", "synchronized", "super", "this", "new", "throw", "else", "do", "try", "assert"}


class _Java:
    def __init__(self, text: str):
        self.k, self.facts = Tokens(text), Facts()
        self.facts.errors = self.k.errors

    def run(self):
        k, i = self.k, 0
        while i < k.n:
            if k.t[i] == "import":
                stop = k.find(i, (";",))
                stop = stop if stop >= 0 else k.n
                parts = [x for x in k.t[i + 1 : stop] if x not in ("static", ".", "*")]
                self.facts.imported(".".join(parts))
                i = stop + 1
            elif k.t[i] in ("class", "interface", "enum") and k.is_id(i + 1) and k.get(i - 1) != ".":
                i = self.type(i, None)
            else:
                i += 1
        return self.facts

    def start(self, i):
        """The first modifier of the declaration that holds token ``i``."""
        k = self.k
        while i > 0 and (k.is_id(i - 1) or k.t[i - 1] in ("@", ">", "<", "[", "]", ",", "?")) and k.t[i - 1] not in (";", "{", "}"):
            i -= 1
        return i

    def type(self, i, scope):
        k, f = self.k, self.facts
        body = k.find(i + 2, ("{",))
        if body < 0:
            return i + 1
        stop = k.close(body)
        fqn = f.symbol(k.t[i + 1], {"class": "class", "interface": "interface", "enum": "enum"}[k.t[i]], scope, k.span(self.start(i), stop), k.t[i + 1])
        j, mode, depth = i + 2, None, 0
        while j < body:
            depth += (k.t[j] == "<") - (k.t[j] == ">")
            if k.t[j] in ("extends", "implements") and not depth:  # a bound of a type parameter is no heritage
                mode = k.t[j]
                if mode == "extends" and k.t[i] == "class":
                    last = k.find(j + 1, ("implements", "{"))
                    f.inherit(fqn, k.source(j + 1, last - 1), "inherits")
            elif mode == "implements" and k.is_id(j):
                f.inherit(fqn, k.t[j], "implements")
            j += 1
        first = body + 1
        if k.t[i] == "enum":  # members follow the constants
            end = k.find(first, (";",))
            first = end + 1 if 0 <= end < stop else stop
        self.body(first, stop, fqn)
        return stop + 1

    def body(self, i, end, scope):
        k, f = self.k, self.facts
        first = i
        while i < end:
            x = k.t[i]
            if x in ("class", "interface", "enum") and k.is_id(i + 1):
                i = first = self.type(i, scope)
            elif k.is_id(i) and k.get(i + 1) == "(" and x not in _JAVA_WORDS and k.get(i - 1) != "@":
                closed = k.close(i + 1)
                after = k.find(closed + 1, ("{", ";"))
                stop = k.close(after) if after >= 0 and k.t[after] == "{" else (after if after >= 0 else closed)
                fqn = f.symbol(x, "method", scope, k.span(first, stop), x + k.source(i + 1, closed))
                if after >= 0 and k.t[after] == "{":
                    self.calls(after + 1, stop, fqn)
                i = first = stop + 1
            elif x in ("=", ";") and first < i:
                stop = k.find(i, (";",))
                stop = stop if 0 <= stop < end else end - 1
                names, j = [i - 1], i
                while j < stop:
                    if k.t[j] in ("(", "{", "["):
                        j = k.close(j)
                    elif k.t[j] == "," and k.is_id(j + 1):
                        names.append(j + 1)
                    j += 1
                for n in names:
                    if k.is_id(n) and k.is_id(first):
                        f.symbol(k.t[n], "variable", scope, k.span(n, n))
                i = first = stop + 1
            elif x == "{":
                self.calls(i + 1, k.close(i), MODULE)
                i = first = k.close(i) + 1
            elif x == "@" and k.is_id(i + 1):
                i += 2
                if k.get(i) == "(":
                    i = k.close(i) + 1
            else:
                i += 1

    def calls(self, i, end, caller):
        k, f = self.k, self.facts
        while i < end:
            if k.t[i] == "new" and k.is_id(i + 1):
                j = k.find(i + 1, ("(", "["), (";",))
                if j >= 0 and k.t[j] == "(":
                    f.call(caller, k.source(i + 1, j - 1), k.span(i, k.close(j)))
                i = j + 1 if j > i else i + 2
            else:
                if k.is_id(i) and k.get(i + 1) == "(" and k.t[i] not in _JAVA_WORDS:
                    f.call(caller, k.t[i], k.span(i, k.close(i + 1)))
                i += 1


class _Go:
    def __init__(self, text: str):
        self.k, self.facts = Tokens(text), Facts()
        self.facts.errors = self.k.errors

    def run(self):
        k, i = self.k, 0
        while i < k.n:
            x = k.t[i]
            if x == "import":
                stop = k.close(i + 1) if k.get(i + 1) == "(" else i + 1 + (k.is_id(i + 1) or k.get(i + 1) in (".", "_"))
                for j in range(i + 1, min(stop + 1, k.n)):
                    if k.kind[j] == "str":
                        self.facts.imported(k.t[j].strip('"`'))
                i = stop + 1
            elif x == "func":
                i = self.function(i)
            elif x == "type":
                i = self.types(i)
            else:
                self.calls(i, i + 1, MODULE)
                i += 1
        return self.facts

    def function(self, i):
        k, f, j, scope = self.k, self.facts, i + 1, None
        if k.get(j) == "(":
            closed = k.close(j)
            names = [x for x in range(j + 1, closed) if k.is_id(x)]
            base = [x for x in names if k.get(x + 1) in ("[", ")") or x == names[-1]]
            scope = k.t[base[0]] if base else None
            j = closed + 1
        if not k.is_id(j):
            return i + 1
        opened = k.find(j + 1, ("(",))
        closed = k.close(opened)
        body = closed + 1
        while body < k.n and k.t[body] != "{" and k.line[body] == k.line[closed]:
            body = k.close(body) + 1 if k.t[body] in ("(", "[") else body + 1
            if body < k.n and k.t[body] == "{" and k.t[body - 1] in ("interface", "struct"):
                body = k.close(body) + 1
        has = body < k.n and k.t[body] == "{"
        stop = k.close(body) if has else closed
        fqn = f.symbol(k.t[j], "method" if scope else "function", scope, k.span(i, stop), k.t[j] + k.source(opened, closed))
        if has:
            self.calls(body + 1, stop, fqn)
        return stop + 1

    def types(self, i):
        k = self.k
        if k.get(i + 1) == "(":
            stop, j = k.close(i + 1), i + 2
            while j < stop:
                j = self.one_type(j, j)
            return stop + 1
        return self.one_type(i, i + 1) if k.is_id(i + 1) else i + 1

    def one_type(self, start, name):
        k = self.k
        if not k.is_id(name):
            return name + 1
        j = name + 1
        while j < k.n and k.line[j] == k.line[name] and k.t[j] != "{":
            j += 1
        opened = j < k.n and k.t[j] == "{" and k.line[j] == k.line[name]
        stop = k.close(j) if opened else j - 1
        kind = "interface" if "interface" in k.t[name + 1 : j] else "class"
        self.facts.symbol(k.t[name], kind, None, k.span(start, stop), k.t[name])
        return stop + 1

    def calls(self, i, end, caller):
        k = self.k
        for j in range(i, end):
            if k.is_id(j) and k.get(j + 1) == "(" and k.t[j] not in ("func", "if", "for", "switch", "return", "go", "defer", "select"):
                self.facts.call(caller, k.t[j], k.span(j, k.close(j + 1)))


WALKERS = {
    "python": _python,
    "typescript": lambda t: _TypeScript(t).run(),
    "tsx": lambda t: _TypeScript(t).run(),
    "javascript": lambda t: _TypeScript(t).run(),
    "java": lambda t: _Java(t).run(),
    "go": lambda t: _Go(t).run(),
}
