"""How many nodes each node of a graph reaches, without writing the pairs.

Nodes get places by name in their project, and PART of them in a row are a part; so
what stands in one package stands mostly in one part. A part's task condenses its
own edges to components (each a set of nodes that reach each other) and goes through
them from the sinks up: what a component reaches is a row of bits, the union of
those behind its edges. Edges that leave the part end at a node whose bits came from
that node's part in the round before. Rounds go on until the bits that parts send
each other no longer grow: as many as the longest way crosses parts, none where a
project is one part. Circles through several parts need nothing special.

Targets are taken GROUP parts at a time, so a task holds PART nodes with GROUP * PART
bits each (64 MB) and the edges of its nodes, whatever the size of the project.

Projects of more than a part are made smaller first, by joins. A node that leads to
one other node reaches that and what that reaches, so chains and trees of such nodes
that nothing branching leads to need no sets: pointer doubling finds their ends and how
far they are. And where a hub
is reached by A nodes and reaches D nodes, all of the A reach all of the D: of the A
only what they reach besides is left to count, and no way to that goes through D, as
all that D leads to is in D. Only what branches, and what that leads to, gets bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import grows, kept

PART = 4096
GROUP = 32
_BYTES = PART // 8
EDGE, ASKED, SENT = 0, 1, 2
#: A hub is given up when it takes more steps than this to what it reaches, or when those that it joins are less than an eighth of all pairs.
WAVES, PAYS = 64, 8


def numbered(rows: DataFrame, scope: str, *order: str) -> DataFrame:
    """``rows`` with ``place``: from 0 by ``order`` in each ``scope``.

    Rows are range-partitioned and counted in their partition, and the counts of
    the partitions before are added, so no task holds a scope.
    """

    def count(batches):
        part, now, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for value in batch.column(batch.schema.get_field_index(scope)).to_pylist():
                nth = nth + 1 if (value,) == now else 0
                now = (value,)
                places.append(nth)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "_part", "_nth"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "_part int", "_nth long"])
    found = kept(rows.repartitionByRange(scope, *order).sortWithinPartitions(scope, *order).mapInArrow(count, schema), "places")
    before = Window.partitionBy(scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy(scope, "_part").count().select(F.col(scope).alias("_scope"), F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    met = found.join(starts, found[scope].eqNullSafe(starts["_scope"]) & (found["_part"] == starts["_p"]))
    return met.select(*rows.columns, (F.col("_start") + F.col("_nth")).alias("place"))


def components(follow: list[list[int]]) -> list[list[int]]:
    """Strongly connected components of nodes 0, 1, ...; a component comes after all that it leads to."""
    found, low, index, open_, on = [], {}, {}, [], set()
    for root in range(len(follow)):
        if root in index:
            continue
        way = [(root, iter(follow[root]))]
        index[root] = low[root] = len(index)
        open_.append(root)
        on.add(root)
        while way:
            node, rest = way[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    open_.append(other)
                    on.add(other)
                    way.append((other, iter(follow[other])))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[node])
                if low[node] == index[node]:
                    one = []
                    while not one or one[-1] != node:
                        one.append(open_.pop())
                        on.discard(one[-1])
                    found.append(one)
    return found


def part_bits(part: int, edges: list[tuple[int, int]], sent: dict, first: int) -> tuple[dict, np.ndarray, int]:
    """(row of each node with edges, bits, first block) of one part, over targets in GROUP parts from ``first`` on.

    ``edges``: places (source, target), sources in the part. ``sent``: what nodes of
    other parts reach, (place, block) to bytes.
    """
    inside = lambda place: place // PART == part
    rows = {place: k for k, place in enumerate(sorted({s for s, _ in edges} | {t for _, t in edges if inside(t)}))}
    # only blocks that something can lead to have columns
    blocks = sorted({b for b in {t // PART for _, t in edges} | {b for _, b in sent} if first <= b < first + GROUP})
    column = {b: k * _BYTES for k, b in enumerate(blocks)}
    bits = np.zeros((len(rows), len(blocks) * _BYTES), np.uint8)
    follow = [[] for _ in rows]
    for source, target in edges:
        at = rows[source]
        if target // PART in column:
            bit = target % PART
            bits[at, column[target // PART] + bit // 8] |= 1 << bit % 8
        if inside(target):
            follow[at].append(rows[target])
        else:
            for block in blocks:
                if (got := sent.get((target, block))) is not None:
                    bits[at, column[block] : column[block] + _BYTES] |= np.frombuffer(got, np.uint8)
    for one in components(follow):
        behind = {n for at in one for n in follow[at]} | set(one)
        whole = np.bitwise_or.reduce(bits[sorted(behind)], axis=0) if len(behind) > 1 else bits[one[0]]
        bits[one] = whole
    return rows, bits, blocks


_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def _run(first: int, kind):
    names = ["project", "kind", "node", "block", "bits", "ones"]
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def unit(project, part, edges, asked, sent):
        rows, bits, blocks = part_bits(part, edges, sent, first)
        ones = _ONES[bits].sum(axis=1, dtype=np.int64) if len(blocks) else np.zeros(len(rows), np.int64)
        own = part in blocks
        column = blocks.index(part) * _BYTES if own else 0
        out = []
        for place, k in rows.items():
            self_ = own and bits[k, column + place % PART // 8] >> (place % PART % 8) & 1
            out.append((project, ASKED, place, None, None, int(ones[k]) - int(self_)))
        for place in asked:
            if (k := rows.get(place)) is not None:
                for nth, block in enumerate(blocks):
                    piece = bits[k, nth * _BYTES : (nth + 1) * _BYTES]
                    if piece.any():
                        out.append((project, SENT, place, block, piece.tobytes(), int(_ONES[piece].sum())))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)

    def run(batches):
        now, edges, asked, sent = None, [], [], {}
        for batch in batches:
            for project, part, what, a, b, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if (project, part) != now:
                    if now is not None:
                        yield unit(*now, edges, asked, sent)
                    now, edges, asked, sent = (project, part), [], [], {}
                if what == EDGE:
                    edges.append((a, b))
                elif what == ASKED:
                    asked.append(a)
                else:
                    sent[a, b] = bits
        if now is not None:
            yield unit(*now, edges, asked, sent)

    return run


def reach(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(project, node, reach): how many other nodes each node reaches over ``edges`` (project, src, dst); more than ``most`` count as ``most``."""
    some = kept(edges.select("project", "src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    nodes = kept(_ends(some), "nodes")
    links = some.where("src <> dst")
    large = _large(nodes)
    if large.isEmpty():
        found = _by_bits(links)
    else:
        found = _by_bits(links.join(large, "project", "left_anti")).unionByName(_by_chains(links.join(large, "project", "left_semi"), _by_hubs))
    total = F.coalesce("reach", F.lit(0)).cast("long")
    return nodes.join(found, ["project", "node"], "left").select("project", "node", (total if most is None else F.least(total, F.lit(most))).alias("reach"))


def _ends(links: DataFrame) -> DataFrame:
    return links.select("project", F.explode(F.array("src", "dst")).alias("node")).distinct()


def _large(nodes: DataFrame) -> DataFrame:
    """Projects of more than a part."""
    return kept(nodes.groupBy("project").count().where(F.col("count") > PART).select("project"), "large")


def _doubled(one: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Where each node of ``one`` (project, node, to: the only node that it leads to) is after 1, 2, 4, ... steps or at the end of its way, and the nodes of circles.

    Each table has ``far``, the steps taken, and ``low``, the least node met; the
    ways of the last one have ended, but for those that come to a circle.
    """
    now = kept(one.select("project", "node", "to", F.lit(1).cast("long").alias("far"), F.least("node", "to").alias("low"), F.lit(True).alias("moved")), "ways")
    levels, n = [now], now.count()
    while True:
        on = now.select("project", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("low").alias("_low"))
        met = now.join(on, ["project", "to"], "left")
        moved = F.col("_far").isNotNull()
        now = kept(met.select("project", "node", F.coalesce("_to", "to").alias("to"), F.when(moved, F.col("far") + F.col("_far")).otherwise(F.col("far")).alias("far"), F.when(moved, F.least("low", "_low")).otherwise(F.col("low")).alias("low"), moved.alias("moved")), "ways")
        going = now.where("moved")
        if going.isEmpty():
            return levels, now.where("moved").select("project", "node", "low")
        levels.append(now)
        if 2 ** (len(levels) - 1) > n:  # whoever still goes is in a circle, and as many steps from any node of a circle come to each of them
            inside = going.select("project", F.col("to").alias("node")).distinct()
            return levels, kept(now.join(inside, ["project", "node"], "left_semi").select("project", "node", "low"), "circles")


def _by_chains(links: DataFrame, rest) -> DataFrame:
    """(project, node, reach) of the nodes that lead to others: what branches is left to ``rest``, together with all that it leads to."""
    out = kept(links.groupBy("project", F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to")), "out")
    one, many = out.where("n = 1").select("project", "node", "to"), out.where("n > 1").select("project", "node")
    if one.isEmpty():
        return rest(links)
    levels, circle = _doubled(one)
    ends = circle.join(circle.groupBy("project", "low").agg(F.count("*").alias("n")), ["project", "low"]).select("project", "node", (F.col("n") - 1).alias("reach"))
    if not many.isEmpty():
        led = kept(links.join(many.withColumnRenamed("node", "src"), ["project", "src"], "left_semi").select("project", F.col("dst").alias("node")).distinct(), "led")
        for level in reversed(levels):  # any number of steps is a sum of different powers of 2
            led = kept(led.unionByName(led.join(level, ["project", "node"]).select("project", F.col("to").alias("node"))).distinct(), "led")
        held = kept(many.unionByName(led).distinct(), "held")
        left = kept(links.join(held.withColumnRenamed("node", "src"), ["project", "src"], "left_semi"), "left")
        ends = ends.join(held, ["project", "node"], "left_anti").unionByName(rest(left).join(held, ["project", "node"], "left_semi"))
    # ways end where they come to a node that is counted otherwise: what branches may lead back to those on the way to it
    ends = kept(ends, "ends")
    ways = levels[-1] if ends.isEmpty() else _doubled(one.join(ends, ["project", "node"], "left_anti"))[0][-1]
    behind = ways.join(ends.withColumnsRenamed({"node": "to", "reach": "_reach"}), ["project", "to"], "left")
    return ends.unionByName(behind.select("project", "node", (F.col("far") + F.coalesce("_reach", F.lit(0))).cast("long").alias("reach")))


def _by_hubs(links: DataFrame) -> DataFrame:
    """(project, node, reach) of the nodes that lead to others, by way of the hub of each project: what many lead to and what leads to many."""
    links = kept(links, "links")
    nodes = _ends(links)
    large = _large(nodes)
    if large.isEmpty():
        return _by_bits(links)
    of_large = links.join(large, "project", "left_semi")
    # steps ahead, and back
    steps = of_large.select("project", F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("src").alias("node"), F.col("dst").alias("to")), F.struct(F.lit(1).alias("back"), F.col("dst").alias("node"), F.col("src").alias("to")))).alias("s")).select("project", "s.*")
    steps = kept(steps, "steps")
    weight = F.count_if(F.col("back") == 0) * F.count_if(F.col("back") == 1)
    hub = steps.groupBy("project", "node").agg(weight.alias("w")).groupBy("project").agg(F.max(F.struct("w", "node")).alias("h"))
    front = kept(hub.select("project", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"), F.col("h.node").alias("node")), "front")
    known = front
    for _ in range(WAVES):
        met = front.join(steps, ["project", "back", "node"]).select("project", "back", F.col("to").alias("node")).distinct()
        front = kept(met.join(known, ["project", "back", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        known = grows(known.unionByName(front))
    else:
        return _by_bits(links)
    side = kept(known.groupBy("project", "node").agg((F.count_if(F.col("back") == 0) > 0).alias("below"), (F.count_if(F.col("back") == 1) > 0).alias("above")), "sides")
    sizes = side.groupBy("project").agg(F.count_if("below").alias("d"), F.count_if("above").alias("a")).join(nodes.groupBy("project").agg(F.count("*").alias("n")), "project")
    pays = kept(sizes.where(F.col("a").cast("double") * F.col("d") * PAYS >= F.col("n").cast("double") * F.col("n")).select("project", "d"), "pays")
    if pays.isEmpty():
        return _by_bits(links)
    others = links.join(pays, "project", "left_anti")
    sided = lambda rows, end: rows.join(side.select("project", F.col("node").alias(end), F.col("below").alias(f"{end}_below"), F.col("above").alias(f"{end}_above")), ["project", end], "left").fillna(False)
    both = kept(sided(sided(links.join(pays, "project", "left_semi"), "src"), "dst"), "sided")
    # besides D, for those that reach the hub; and all, for those that don't
    beside = both.where("not src_below and not dst_below").select(F.struct("project", F.lit(0).alias("part")).alias("project"), "src", "dst")
    apart = both.where("not src_above").select(F.struct("project", F.lit(1).alias("part")).alias("project"), "src", "dst")
    more = kept(_by_chains(kept(beside.unionByName(apart), "apart"), _by_bits).select("project.project", "project.part", "node", "reach"), "more")
    asked = both.groupBy("project", F.col("src").alias("node")).agg(F.bool_or("src_below").alias("below"), F.bool_or("src_above").alias("above"))
    asked = asked.withColumn("part", F.when(F.col("above"), 0).otherwise(1)).join(more, ["project", "part", "node"], "left").join(pays, "project")
    rest = F.coalesce("reach", F.lit(0))
    found = asked.select("project", "node", F.when(F.col("above") & F.col("below"), F.col("d") - 1).when(F.col("above"), F.col("d") + rest).otherwise(rest).cast("long").alias("reach"))
    return found.unionByName(_by_bits(others))


def _by_bits(some: DataFrame) -> DataFrame:
    """(project, node, reach) of all nodes of ``some`` (project, src, dst; distinct), part by part."""
    nodes = kept(numbered(_ends(some), "project", "node"), "nodes")
    at = lambda end: nodes.select("project", F.col("node").alias(end), F.col("place").alias(f"_{end}"))
    placed = some.join(at("src"), ["project", "src"]).join(at("dst"), ["project", "dst"])
    part = lambda c: F.floor(F.col(c) / F.lit(PART)).cast("long")
    links = kept(placed.select("project", part("_src").alias("part"), F.col("_src").alias("a"), F.col("_dst").alias("b")), "links")
    across = links.where(F.col("part") != part("b"))
    asked = across.select("project", part("b").alias("part"), F.col("b").alias("a")).distinct()
    wants = across.select("project", "part", F.col("b").alias("node")).distinct()
    none = F.lit(None)
    rows = lambda df, what, b, bits: df.select("project", "part", F.lit(what).alias("kind"), "a", b.cast("long").alias("b"), bits.cast("binary").alias("bits"))
    fixed = rows(links, EDGE, F.col("b"), none).unionByName(rows(asked, ASKED, none, none))
    project = some.schema["project"].dataType
    schema = f"project {project.simpleString()}, kind int, node long, block long, bits binary, ones long"
    from pyspark.sql.pandas.types import to_arrow_type

    last = nodes.agg(F.max("place")).first()[0]
    counts = []
    for first in range(0, (last if last is not None else -1) // PART + 1, GROUP):
        sent, before = None, 0
        while True:
            every = fixed
            if sent is not None:
                every = every.unionByName(rows(sent.join(wants, ["project", "node"]).withColumn("a", F.col("node")), SENT, F.col("block"), F.col("bits")))
            units = every.repartition("project", "part").sortWithinPartitions("project", "part", "kind")
            found = kept(units.mapInArrow(_run(first, to_arrow_type(project)), schema), "reach")
            sent = found.where(F.col("kind") == SENT)
            ones = sent.agg(F.sum("ones")).first()[0] or 0
            if ones == before:
                break
            before = ones
        counts.append(found.where(F.col("kind") == ASKED).select("project", F.col("node").alias("place"), "ones"))
    if not counts:
        return nodes.select("project", "node", F.lit(0).cast("long").alias("reach"))
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    sums = every.groupBy("project", "place").agg(F.sum("ones").alias("reach"))
    return nodes.join(sums, ["project", "place"], "left").select("project", "node", F.coalesce("reach", F.lit(0)).cast("long").alias("reach"))
