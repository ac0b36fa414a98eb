"""Queries of the scanners over ``samples``: each oracle states, file by file, what the extractor rules ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import index, samples
from .catalog import query


def _values(columns: str, *rows: tuple) -> str:
    def text(x):
        if x is None:
            return "NULL"
        return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


_PY, _TS, _JS, _TSX, _JAVA, _GO = "tide/gauge.py", "deck/winch.ts", "deck/rig.js", "deck/View.tsx", "mill/Mill.java", "kiln/kiln.go"


@query(
    _values(
        "path, fqn, kind, signature, parent_fqn, start_line",
        (_PY, "LIMIT", "variable", None, None, 6),
        (_PY, "low", "variable", None, None, 7),
        (_PY, "high", "variable", None, None, 7),
        (_PY, "offset", "variable", None, None, 10),
        (_PY, "Gauge", "class", "Gauge", None, 14),
        (_PY, "Gauge.unit", "variable", None, "Gauge", 16),
        (_PY, "Gauge.scale", "variable", None, "Gauge", 17),
        (_PY, "Gauge.level", "method", "level(self)", "Gauge", 20),
        (_PY, "Gauge.level.smooth", "function", "smooth(xs, k=window())", "Gauge.level", 21),
        (_PY, "Gauge.poll", "method", "poll(self, *, every=1.0)", "Gauge", 26),
        (_PY, "Gauge.Probe", "class", "Probe", "Gauge", 30),
        (_PY, "Gauge.Probe.dip", "method", "dip(self)", "Gauge.Probe", 31),
        (_PY, "drain", "function", 'drain(g: "Gauge")', None, 34),
        (_TS, "Load", "type", "Load", None, 6),
        (_TS, "Mode", "enum", "Mode", None, 7),
        (_TS, "Drum", "interface", "Drum", None, 8),
        (_TS, "speed", "variable", None, None, 11),
        (_TS, "brake", "variable", None, None, 11),
        (_TS, "ease", "function", "ease(n: number)", None, 12),
        (_TS, "Winch", "class", "Winch", None, 14),
        (_TS, "Winch.constructor", "method", "constructor(private rope: Rope)", "Winch", 16),
        (_TS, "Winch.turns", "method", "turns(n: number)", "Winch", 17),
        (_TS, "Winch.turns.step", "function", "step(k: number)", "Winch.turns", 17),
        (_TS, "Winch.slack", "method", "slack()", "Winch", 18),
        (_TS, "start", "method", "start()", None, 21),
        (_TS, "haul", "function", "haul(w: Winch)", None, 23),
        (_TS, "haul.wait", "function", "wait()", "haul", 24),
        (_JS, "Rig", "class", "Rig", None, 1),
        (_JS, "Rig.hoist", "method", "hoist()", "Rig", 2),
        (_JS, "tack", "function", "tack()", None, 4),
        (_JS, "count", "variable", None, None, 5),
        (_TSX, "View", "function", "View(p: Props)", None, 3),
        (_JAVA, "Mill", "class", "Mill", None, 7),
        (_JAVA, "Mill.SPEED", "variable", None, "Mill", 8),
        (_JAVA, "Mill.SPARE", "variable", None, "Mill", 8),
        (_JAVA, "Mill.sacks", "variable", None, "Mill", 9),
        (_JAVA, "Mill.Mill", "method", "Mill(int stones)", "Mill", 11),
        (_JAVA, "Mill.turn", "method", "turn(int n)", "Mill", 13),
        (_JAVA, "Mill.turn", "method", "turn(String s)", "Mill", 14),
        (_JAVA, "Mill.Hopper", "class", "Hopper", "Mill", 16),
        (_JAVA, "Mill.Hopper.fill", "method", "fill()", "Mill.Hopper", 17),
        (_JAVA, "Wheel", "interface", "Wheel", None, 21),
        (_JAVA, "Wheel.spin", "method", "spin(int i)", "Wheel", 21),
        (_JAVA, "Grade", "enum", "Grade", None, 23),
        (_JAVA, "Grade.next", "method", "next()", "Grade", 23),
        (_GO, "Temp", "class", "Temp", None, 9),
        (_GO, "Firer", "interface", "Firer", None, 11),
        (_GO, "Shelf", "class", "Shelf", None, 12),
        (_GO, "Kiln.Fire", "method", "Fire(t Temp)", "Kiln", 17),
        (_GO, "Shelf.Load", "method", "Load(p ...Pot)", "Shelf", 23),
        (_GO, "New", "function", "New(size int)", None, 25),
    )
)
def extract_symbols(spark, d):
    """Functions, methods, classes, types and variables of all languages."""
    rows = index.full(samples.files(spark)).exploded("symbols").where("path not like 'bad/%'")
    signature = F.when(F.col("kind") != "variable", F.col("signature"))
    return rows.select("path", "fqn", "kind", signature.alias("signature"), "parent_fqn", "start_line")


@query(
    _values(
        "path, caller_fqn, callee_name",
        (_PY, "<module>", "calibrate"),
        (_PY, "<module>", "register"),
        (_PY, "<module>", "factor"),
        (_PY, "Gauge.level.smooth", "mean(xs)[0]"),
        (_PY, "Gauge.level.smooth", "mean"),
        (_PY, "Gauge.level", "smooth"),
        (_PY, "Gauge.level", "read"),
        (_PY, "Gauge.poll", "tick"),
        (_PY, "Gauge.Probe.dip", "z"),
        (_PY, "drain", "show"),
        (_PY, "drain", "max"),
        (_TS, "ease", "slip"),
        (_TS, "Winch.constructor", "coil"),
        (_TS, "Winch.turns.step", "pull"),
        (_TS, "Winch.turns", "step"),
        (_TS, "start", "ignite"),
        (_TS, "haul.wait", "rest"),
        (_TS, "haul", "pull"),
        (_TS, "haul", "then"),
        (_TS, "<module>", "haul"),
        (_JS, "Rig.hoist", "raise"),
        (_JS, "tack", "hoist"),
        (_TSX, "View", "draw"),
        (_JAVA, "Mill.Mill", "turn"),
        (_JAVA, "Mill.turn", "spin"),
        (_JAVA, "Mill.turn", "turn"),
        (_JAVA, "Mill.turn", "length"),
        (_JAVA, "Mill.Hopper.fill", "Sack<Grain>"),
        (_JAVA, "Mill.Hopper.fill", "tie"),
        (_JAVA, "Grade.next", "values"),
        (_GO, "Kiln.Fire", "Close"),
        (_GO, "Kiln.Fire", "cool"),
        (_GO, "Kiln.Fire", "Errorf"),
        (_GO, "Shelf.Load", "append"),
        (_GO, "New", "now"),
    )
)
def extract_calls(spark, d):
    return index.full(samples.files(spark)).exploded("calls").where("path not like 'bad/%'").select("path", "caller_fqn", "callee_name")


@query(
    _values(
        "path, module, symbols, alias",
        (_PY, "os.path", "", None),
        (_PY, "json", "", "j"),
        (_PY, ".", "clock", None),
        (_PY, "..sea", "Wave,Swell as S", None),
        (_TS, "./rope", "Rope", None),
        (_TS, "./knots", "Knot,Hitch", None),
        (_TS, "gear", "", "gear"),
        (_TS, "./polyfill", "", None),
        (_TSX, "./draw", "draw", None),
        (_JAVA, "java.util", "", None),
        (_JAVA, "mill.Gears.mesh", "", None),
        (_JAVA, "mill.Grain", "", None),
        (_GO, "fmt", "", None),
        (_GO, "os", "", None),
        (_GO, "kiln/clay", "", None),
    )
)
def extract_imports(spark, d):
    rows = index.full(samples.files(spark)).exploded("imports").where("path not like 'bad/%'")
    return rows.select("path", "module", F.array_join("symbols", ",").alias("symbols"), "alias")


@query(
    _values(
        "path, subclass_fqn, base_name, kind",
        (_PY, "Gauge", "sea.Sensor", "inherits"),
        (_PY, "Gauge", "Base", "inherits"),
        (_TS, "Winch", "Machine", "inherits"),
        (_TS, "Winch", "Drum", "implements"),
        (_TS, "Winch", "Lockable", "implements"),
        (_JS, "Rig", "Base", "inherits"),
        (_JAVA, "Mill", "Plant<G>", "inherits"),
        (_JAVA, "Mill", "Runnable", "implements"),
        (_JAVA, "Mill", "Comparable", "implements"),
        (_JAVA, "Mill", "Mill", "implements"),
    )
)
def extract_inherits(spark, d):
    return index.full(samples.files(spark)).exploded("inherits").where("path not like 'bad/%'").select("path", "subclass_fqn", "base_name", "kind")


@query(
    _values(
        "path, language, broken",
        *((p, n, False) for p, n in ((_PY, "python"), (_TS, "typescript"), (_JS, "javascript"), (_TSX, "tsx"), (_JAVA, "java"), (_GO, "go"), ("bad/empty.py", "python"))),
        *((p, n, True) for p, n in (("bad/open.py", "python"), ("bad/open.ts", "typescript"), ("bad/Open.java", "java"), ("bad/open.go", "go"))),
    )
)
def extract_errors(spark, d):
    """Broken files count errors and never end the job; files of other languages give no facts."""
    return index.facts(samples.files(spark)).select("path", "language", (F.col("parse_errors") > 0).alias("broken"))


@query(_values("path, docstring", (_PY, "'''Reads the tide.'''"), (_PY, '"""Waits."""')))
def extract_docstrings(spark, d):
    return index.full(samples.files(spark)).exploded("symbols").where("docstring is not null").select("path", "docstring")


@query(
    _values(
        "src_path, src_fqn, dst_path, dst_fqn, confidence",
        *((_PY, a, _PY, b, 1) for a, b in (("Gauge.level", "Gauge.level.smooth"),)),
        (_TS, "<module>", _TS, "haul", 1),
        (_TS, "Winch.turns", _TS, "Winch.turns.step", 1),
        (_JS, "tack", _JS, "Rig.hoist", 1),
        (_JAVA, "Mill.Mill", _JAVA, "Mill.turn", 1),
        (_JAVA, "Mill.turn", _JAVA, "Wheel.spin", 1),
    )
)
def extract_call_edges(spark, d):
    """Edges of the sample files: a method that calls its own overload, which has its name and key, is no edge."""
    return index.full(samples.files(spark)).calls.select("src_path", "src_fqn", "dst_path", "dst_fqn", F.col("confidence").cast("int").alias("confidence"))
