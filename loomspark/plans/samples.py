"""A small table of source files in every language the scanners know, for queries and tests of the extractor rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import language_of

GAUGE = '''from __future__ import annotations
import os.path, json as j
from . import clock
from ..sea import Wave, Swell as S

LIMIT: int = 4
low = high = None
a, b = 1, 2
if LIMIT:
    offset = calibrate(LIMIT)


@register("gauge")
class Gauge(sea.Sensor, Base, Generic[T], metaclass=Meta):
    \'\'\'Reads the tide.\'\'\'
    unit = "m"
    scale = factor()

    @property
    def level(self):
        def smooth(xs, k=window()):
            return mean(xs)[0](k)
        return smooth(self.raw.read())

    if True:
        async def poll(self, *, every=1.0):
            """Waits."""
            await self.clock.tick()

    class Probe:
        def dip(self): self.x.y.z()


def drain(g: "Gauge") -> None:
    t = g.level
    fmt = lambda v: show(v)
    for reading in g:
        worst = max(reading, t)
'''

WINCH = '''import Rope from "./rope";
import { Knot, Hitch } from './knots';
import * as gear from "gear";
import "./polyfill";

export type Load = number | { kg: number };
enum Mode { Idle, Haul }
interface Drum<T> extends Base { turns: T; spin(n: number): void }

const { left, right } = split(gear);
let speed = 3, brake;
export const ease = async (n: number) => { await gear.slip(n); };

export class Winch extends Machine implements Drum, Lockable {
  load = 0;
  constructor(private rope: Rope) { rope?.coil(); }
  static *turns(n: number) { const step = (k: number) => pull(k); yield step(n); }
  get slack() { return this.rope.length; }
}

abstract class Motor { start() { ignite(); } }

function haul(w: Winch) {
  const wait = function () { rest(); };
  var other = new Winch(w.rope);
  return w.rope.pull(2).then(wait);
}
haul(speed);
'''

RIG = '''class Rig extends Base {
  hoist() { sail.raise(); }
}
const tack = function () { rig.hoist(); };
var count = 0;
'''

VIEW = '''import { draw } from "./draw";

export const View = (p: Props) => { return draw(p); };
'''

MILL = '''package mill;

import java.util.*;
import static mill.Gears.mesh;
import mill.Grain;

public abstract class Mill<G extends Grain> extends Plant<G> implements Runnable, Comparable<Mill> {
    private static final int SPEED = limit(), SPARE = 2;
    String[] sacks;

    public Mill(int stones) { this.turn(stones); }

    void turn(int n) { for (int i = 0; i < n; i++) wheel.spin(i); }
    void turn(String s) { turn(s.length()); }

    static class Hopper {
        void fill() { new Sack<Grain>(SPEED).tie(); }
    }
}

interface Wheel { void spin(int i); }

enum Grade { FINE, COARSE; Grade next() { return values()[0]; } }
'''

KILN = '''package kiln

import f "fmt"
import (
	"os"
	. "kiln/clay"
)

type Temp float64
type (
	Firer interface{ Fire(t Temp) error }
	Shelf struct{ pots []Pot }
)

var fired int

func (k *Kiln) Fire(t Temp) error {
	go k.door.Close()
	defer cool(t)
	return f.Errorf("hot %v", t)
}

func (s Shelf) Load(p ...Pot) { s.pots = append(s.pots, p...) }

func New(size int) *Kiln { return &Kiln{size: size, made: now()} }
'''

SOURCES = {
    "tide/gauge.py": GAUGE,
    "deck/winch.ts": WINCH,
    "deck/rig.js": RIG,
    "deck/View.tsx": VIEW,
    "mill/Mill.java": MILL,
    "kiln/kiln.go": KILN,
    "notes/plan.toml": "[plan]\ndays = 3\n",
    "bad/open.py": "class Half:\n    pass\n\ndef broken(:\n    pass\n",
    "bad/open.ts": "function half( { return [1, 2); }\n",
    "bad/Open.java": "class Half { void f( { }\n",
    "bad/open.go": "func half() { if (x { }\n",
    "bad/empty.py": "",
}


def files(spark: SparkSession) -> DataFrame:
    """repo_id, path, language, content, content_hash of ``SOURCES``."""
    rows = spark.createDataFrame([("samples", p, t) for p, t in SOURCES.items()], "repo_id string, path string, text string")
    content = F.encode("text", "UTF-8")
    return rows.select("repo_id", "path", language_of(F.col("path")).alias("language"), content.alias("content"), F.sha2(content, 256).alias("content_hash"))
