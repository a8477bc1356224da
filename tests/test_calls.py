"""Call resolution: names, bindings, attributes, lineages; expected edges written by hand, lineages by brute force."""

import random

import pytest

from codeloom.operators import calls, facts
from codeloom.operators.lineage import lineage, merge_c3

SCHEMA = "project string, module string, is_package boolean, content string"


def edges(spark, files, packages=()):
    data = [("p", m, m in packages, t) for m, t in files.items()]
    rows = facts.facts(spark.createDataFrame(data, SCHEMA)).cache()
    found = {}
    for r in calls.call_edges(rows).orderBy("caller", "ord").collect():
        found.setdefault(r["caller"], []).append(r["named"])
        assert r["is_internal"] == ("." in r["named"])
    return found


CORE = """
class Engine:
    def start(self): ...
    def stop(self): ...
    def twin(self) -> "Engine": ...
    def part(self) -> "Part": ...


class Part:
    def run(self): ...


def save(): ...


def open(): ...


def make() -> Engine: ...
"""

APP = """
import os.path
from app.core import Engine, make, save
from app.core import Part as P
from lib import core as far


def builtin():
    open('x')


def shadowed(save, *make, **P):
    save()
    make()
    P.run()


def looped(things, pair):
    for save in things:
        save()
    with pair as (make, _):
        make()
    try:
        pass
    except ValueError as P:
        P.run()


def union(e: Engine | int, f: "None | Engine", g: 'Union[Engine, str]', h: Engine | P):
    e.start()
    f.stop()
    g.twin()
    h.run()


def starred(*es: Engine):
    es.start()


class Car:
    spare = Engine()

    def go(this):
        this.stop()
        this.spare.start()

    def stop(this): ...

    @staticmethod
    def build(other):
        other.stop()


def renamed():
    e = Engine()
    d = e
    d.start()


def chained():
    make().part().run()
    x = make().part()
    x.run()
    make().twin().twin().stop()


def rebound(flag):
    x = Engine()
    y = x
    x = P()
    y.start()
    x.run()
    z = P()
    z = unknown()
    z.run()


def outer():
    e = make()
    def inner(save):
        save()
        e.stop()
    inner(1)


async def awaited(items):
    e = await fetch()
    e.start()
    items[0].close()
    "".join(items)


async def fetch() -> Engine: ...


def placed(config):
    os.flag = 1
    os.getcwd()


def far_away():
    far.make()
    far.Engine().start()
    far.Engine.stop()
    far.none()
"""


@pytest.fixture(scope="module")
def found(spark):
    return edges(spark, {"app.core": CORE, "app.main": APP, "pkg.lib.core": CORE, "other": CORE})


E = "app.core.Engine"


@pytest.mark.parametrize(
    "caller, named",
    [
        ("builtin", ["open"]),
        ("shadowed", ["save", "make", "run"]),
        ("looped", ["save", "make", "run"]),
        ("union", [f"{E}.start", f"{E}.stop", f"{E}.twin", "run"]),
        ("starred", [f"{E}.start"]),
        ("Car.go", ["app.main.Car.stop", f"{E}.start"]),
        ("Car.build", ["stop"]),
        ("renamed", [E, f"{E}.start"]),
        ("chained", ["app.core.make", f"{E}.part", "app.core.Part.run", f"{E}.twin", f"{E}.stop"]),
        ("outer", ["app.core.make", "inner"]),
        ("outer.inner", ["save", f"{E}.stop"]),
        ("awaited", ["app.main.fetch", f"{E}.start", "close", "join"]),
        ("placed", ["getcwd"]),
        ("far_away", ["pkg.lib.core.make", "pkg.lib.core.Engine", "pkg.lib.core.Engine.start", "pkg.lib.core.Engine.stop", "none"]),
    ],
)
def test_call_sites(found, caller, named):
    assert found.get(f"app.main.{caller}", []) == named


def test_a_name_bound_to_two_classes_is_not_traced(found):
    # x holds both at its calls, z one class and something unknown
    assert found["app.main.rebound"] == [E, "app.core.Part", f"{E}.start", "run", "unknown", "app.core.Part.run"]


ATTRIBUTES = """
class Base:
    def __init__(self, engine: "Engine"):
        self.engine = engine
        self.maybe: Engine | None = None
        both = Engine()
        both = Tool()
        self.both = both

    def ping(self): ...


class Engine:
    def start(self): ...
    def owner(self) -> Base: ...


class Tool:
    def start(self): ...


class Left(Base):
    def engine(self): ...


class Right(Base):
    @property
    def best(self) -> Engine: ...

    def ping(self): ...


class Both(Left, Right):
    tool = Tool()

    def run(self):
        super().ping()
        self.ping()
        self.engine.start()
        self.maybe.start()
        self.both.start()
        self.best.owner().engine.start()
        self.late.start()
        self.tool.start()

    def set(self):
        self.late = self.best.owner().maybe


class Ring:
    def a(self):
        self.x = self.y.z
        self.w = Tool()

    def b(self):
        self.y = self.x.z
        self.z = self.w

    def c(self):
        self.x.start()
        self.z.start()
        self.y.start()


class Outer:
    class Inner:
        def go(self):
            self.other()

        def other(self): ...
"""


def test_attributes_and_lineages(spark):
    found = edges(spark, {"m": ATTRIBUTES})
    assert found["m.Both.run"] == ["m.Right.ping", "start", "m.Engine.start", "m.Engine.owner", "m.Tool.start"]
    assert found["m.Ring.c"] == ["start", "m.Tool.start"]
    assert found["m.Outer.Inner.go"] == ["other"]


# --- lineage ---------------------------------------------------------------------------------------


def plain_order(cls, bases):
    def chain(c):
        own = bases.get(c, [])
        merged = merge_c3([*(chain(b) for b in own), own])
        return deep(c) if merged is None else [c, *merged]

    def deep(c):
        out = [c]
        for b in bases.get(c, []):
            out += [x for x in deep(b) if x not in out]
        return out

    return chain(cls)


def orders(spark, bases):
    data = [("p", c, k, b) for c, bs in bases.items() for k, b in enumerate(bs or [None])]
    found = {}
    for r in lineage(spark.createDataFrame(data, "project string, cls string, ord int, base string")).orderBy("cls", "ord").collect():
        found.setdefault(r["cls"], []).append(r["base"])
    return found


@pytest.mark.parametrize("seed", range(4))
def test_lineage_equals_plain_merge(spark, seed):
    rng = random.Random(seed)
    names = [f"c{k:03}" for k in range(60)]
    rng.shuffle(names)
    bases = {c: rng.sample(names[:k], min(k, rng.choice([0, 1, 1, 1, 2, 3]))) for k, c in enumerate(names)}
    assert orders(spark, bases) == {c: plain_order(c, bases) for c in names}


def test_stacked_diamonds_and_long_chains(spark):
    bases = {"a00": []}
    for k in range(18):  # derived classes sort before their bases
        bases |= {f"l{50 - k}": [f"a{k:02}"], f"r{50 - k}": [f"a{k:02}"], f"a{k + 1:02}": [f"l{50 - k}", f"r{50 - k}"]}
    bases |= {f"x{k:03}": [f"x{k - 1:03}"] if k else ["a18"] for k in range(200)}
    found = orders(spark, bases)
    assert found["x199"][:201] == [f"x{k:03}" for k in range(199, -1, -1)] + ["a18"] and len(found["x199"]) == 200 + 55
    assert found["a02"] == ["a02", "l49", "r49", "a01", "l50", "r50", "a00"]


def test_circles_end(spark):
    bases = {"A": ["B"], "B": ["C"], "C": ["A"], "T": ["A"], "L": ["L"], "X": ["Y", "Z"], "Y": ["X"], "Z": [], "D": ["X"], "E": ["D", "Z"]}
    found = orders(spark, bases)
    assert found["A"] == ["A", "B", "C"] and found["C"] == ["C", "A", "B"] and found["T"] == ["T", "A", "B", "C"] and found["L"] == ["L"]
    assert found["X"] == ["X", "Y", "Z"] and found["Y"] == ["Y", "X", "Z"] and found["D"] == ["D", "X", "Y", "Z"] and found["E"] == ["E", "D", "X", "Y", "Z"]


def test_conflicting_orders_are_depth_first(spark):
    bases = {"Base": [], "Left": ["Base"], "Right": ["Base"], "X": ["Left", "Right"], "Y": ["Right", "Left"], "Z": ["X", "Y"]}
    assert orders(spark, bases)["Z"] == ["Z", "X", "Left", "Base", "Right", "Y"]
