"""Merkle manifest of a table: a tree for each source, a tree of their roots above, a proof for each row.

Runs of three consecutive digests become their parent. Nodes are labelled by
(last leaf below them, level), so a child's label is smaller than its parent's, and
digests are worked off forward in the order of labels: a priority queue holds, by
the receiver's label, the digests sent so far, and a node is made when its label is
least. Proofs go backward through the same labels: a parent sends each child the
siblings of that child followed by its own proof.

The queue is external where it is long: a block is 3^LEVELS consecutive leaves of a
tree; its root is sent to the next round through a shuffle sorted by label, and
proofs come back alike, through the blocks' own shuffle. Inside a block the queue
holds at most two digests a level. Each round leaves one row of 3^LEVELS, so a
source of 10^10 rows takes four rounds, and no task holds a source.

Positions in a tree come from ranges: rows are range-partitioned by tree and order,
numbered in their partition, and the counts of partitions before are added.

Defined results: a null field is ``-``; null ids come first in their source and are
never tampered with; equal ids are ordered by leaf, so equal rows are
interchangeable; the null source has a tree of its own, first of all; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, stored

FAN = 3
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = 2048


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while FAN**levels < n:
        levels += 1
    return levels


def label(level: int, index: int, n: int) -> tuple[int, int]:
    """Of a node over a block of ``n`` leaves: its last leaf, then its level."""
    return min((index + 1) * FAN**level, n) - 1, level


def send_up(leaves: list[str], levels: int) -> list[list[str]]:
    """The digests of each level of a block, from the leaves to its root."""
    n, queue, made = len(leaves), [], [[] for _ in range(levels + 1)]

    def keep(level: int, index: int, value: str) -> None:
        made[level].append(value)
        if level < levels:
            heappush(queue, (label(level + 1, index // FAN, n), index, value))

    for at, leaf in enumerate(leaves):
        keep(0, at, leaf)
        while queue and queue[0][0][0] == at:
            now, first, text = heappop(queue)
            while queue and queue[0][0] == now:
                text += heappop(queue)[2]
            keep(now[1], first // FAN, digest(text))
    return made


def send_down(made: list[list[str]], above: tuple):
    """(leaf's index, proof) from the last leaf to the first. A proof is (left siblings, right siblings, all text from here on, the proof above) or ()."""
    levels, n = len(made) - 1, len(made[0])
    queue = [((-label(levels, 0, n)[0], -levels), 0, above)]
    while queue:
        (_, low), index, proof = heappop(queue)
        level = -low
        if level == 0:
            yield index, proof
            continue
        run = made[level - 1][index * FAN : index * FAN + FAN]
        for k in range(len(run)):
            left, right = "".join(run[:k]), "".join(run[k + 1 :])
            child = index * FAN + k
            end, _ = label(level - 1, child, n)
            heappush(queue, ((-end, 1 - level), child, (left, right, left + right + (proof[2] if proof else ""), proof)))


def linked(path: list[str]) -> tuple:
    """[left, right, left, right, ...] from below as the proof of ``send_down``."""
    proof = ()
    for k in range(len(path) - 2, -1, -2):
        proof = (path[k], path[k + 1], path[k] + path[k + 1] + (proof[2] if proof else ""), proof)
    return proof


def flat(proof: tuple) -> list[str]:
    out = []
    while proof:
        out += proof[:2]
        proof = proof[3]
    return out


def fold(leaf: str, proof: tuple) -> str:
    """The root that ``leaf`` and its proof give."""
    while proof:
        leaf = digest(proof[0] + leaf + proof[1])
        proof = proof[3]
    return leaf


def _blocks(batches):
    """Rows that stand together by tree and block (their first two fields)."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != now:
                if rows:
                    yield rows
                now, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _batches(rows, schema: pa.Schema):
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)


def _numbered(batches):
    """Adds the partition's number and the row's in its tree (first column) within the partition."""
    part, now, nth = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        numbers = []
        for tree in batch.column(0).to_pylist():
            nth = nth + 1 if tree == now else 0
            now = tree
            numbers.append(nth)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())], names=[*batch.schema.names, "_part", "_nth"])


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (tree first) with ``pos`` (from 0 by ``order`` in the tree) and ``n`` (the tree's nodes)."""
    names = [f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields]
    ranges = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = stored(ranges.mapInArrow(_numbered, ", ".join([*names, "_part int", "_nth long"])), "merkle-ranges")
    counts = rows.groupBy("tree", "_part").count()
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"), F.sum("count").over(tree).alias("n"))
    return rows.join(starts, ["tree", "_part"]).select(*nodes.columns, (F.col("_start") + F.col("_nth")).alias("pos"), "n")


def _up(batches):
    def roots():
        for rows in _blocks(batches):
            tree, block, _, n, _ = rows[0]
            yield tree, block, -(-n // FAN**LEVELS), send_up([r[4] for r in rows], min(LEVELS, height(n)))[-1][0]

    yield from _batches(roots(), pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))


def _block():
    return F.floor(F.col("pos") / F.lit(FAN**LEVELS)).cast("long").alias("block")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, pos, n, digest), then the roots of their blocks, and so on to one row for each tree."""
    made = [nodes]
    while (made[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = made[-1].select("tree", _block(), "pos", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        made.append(stored(blocks.mapInArrow(_up, "tree string, pos long, n long, digest string"), "merkle-round"))
    return made


def _down(full: bool):
    """Blocks with what was sent to them, which stands first: the path from the block's root on, the tree's root, the root of all."""
    paths = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
    found = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string()))])

    def run(batches):
        def rows():
            for sent, *block in _blocks(batches):
                tree, _, _, _, _, _, _, path, subroot, root = sent
                levels = min(LEVELS, height(block[0][3]))
                for index, proof in send_down(send_up([r[4] for r in block], levels), linked(path)):
                    _, _, pos, _, leaf, doc_id, candidate, _, _, _ = block[index]
                    if not full:
                        yield tree, pos, flat(proof), subroot, root
                        continue
                    folded = fold(candidate or leaf, proof)
                    yield doc_id, leaf, subroot, root, digest(proof[2] if proof else ""), folded, folded == root, tree, pos, flat(proof) if full == "paths" else None

        yield from _batches(rows(), found if full else paths)

    return run


_PATHS = "tree string, pos long, path array<string>, subroot string, root string"
_FOUND = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, tree string, pos long, path array<string>"


def backward(made: list[DataFrame], top: DataFrame, full="rows") -> DataFrame:
    """From ``top`` (tree, pos 0, path, subroot, root) back through ``rounds`` to the leaves (with doc_id and candidate), or only their paths if not ``full``."""
    sent = top
    for k in range(max(len(made) - 2, 0), -1, -1):
        nodes = made[k] if k == 0 and full else made[k].withColumns({"doc_id": F.lit(None).cast("long"), "candidate": F.lit(None).cast("string")})
        nodes = nodes.select("tree", _block(), "pos", "n", "digest", "doc_id", "candidate", F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
        messages = sent.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("candidate"), "path", "subroot", "root")
        both = nodes.unionByName(messages).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        last = k == 0 and full
        sent = both.mapInArrow(_down(full if last else False), _FOUND if last else _PATHS)
        if not last:
            sent = stored(sent, "merkle-paths")
    return sent


def field(name: str, value=None) -> F.Column:
    text = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(fields=FIELDS, **changed) -> F.Column:
    """Digest of a row's fields; ``changed`` gives other values of some."""
    return F.sha2(F.concat(*[field(f, changed.get(f)) for f in fields]).cast("binary"), 256)


def manifest(docs: DataFrame, candidate=None, fields=FIELDS, paths: bool = False) -> DataFrame:
    """For each of ``docs`` (doc_id, source and ``fields``): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tree, pos.

    ``candidate`` is the digest to be verified in the leaf's place (null: the leaf
    itself). ``tree`` is the source behind a 1, or 0 for null. With ``paths`` a column
    ``path`` holds the proof: left and right siblings' digests level by level.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).alias("tree")
    other = F.lit(None).cast("string") if candidate is None else candidate
    leaves = docs.select(tree, F.col("doc_id").cast("long").alias("doc_id"), row_digest(fields).alias("digest"), other.alias("candidate"))
    leaves = stored(leaves, "merkle-rows")  # else texts are read and hashed again to draw the ranges' bounds
    leaves = stored(placed(leaves, "doc_id", "digest", "candidate"), "merkle-leaves")
    made = rounds(leaves)
    roots = made[-1].select("tree", F.col("digest").alias("subroot"))
    above = stored(placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest")), "name"), "merkle-roots")
    upper = rounds(above.select("tree", "pos", "n", "digest"))
    root = upper[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    down = backward(upper, root, full=None).drop("subroot")
    top = above.select("tree", "pos", "name", F.col("digest").alias("subroot")).join(down, ["tree", "pos"])
    top = top.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    found = backward(made, top, "paths" if paths else "rows")
    return found if paths else found.drop("path")


def tampered(fields=FIELDS) -> F.Column:
    """Digest of the row without its text's line feeds where 2 divides the id's crc32, else null."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit & F.contains("text", F.lit("\n")), row_digest(fields, text=F.translate("text", "\n", "")))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """All documents' leaves, roots, proofs and the root that tampered rows give; columns as ``manifest``."""
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    return manifest(docs, tampered()).drop("tree", "pos")


_LEAF = "sha256(concat({}))"
_SQL_FIELD = "coalesce(concat(CAST(strlen({0}) AS VARCHAR), ':', {0}), '-')"


def _sql_leaf(text: str) -> str:
    return _LEAF.format(", ".join(_SQL_FIELD.format(text if f == "text" else f"CAST({f} AS VARCHAR)") for f in FIELDS))


#: Trees by recursion over levels; crc32 of the id by its table, made bit by bit.
OP12_SQL = f"""
WITH RECURSIVE
bits AS (SELECT CAST(k AS BIGINT) AS k, CAST(k AS BIGINT) AS v, 0 AS step FROM range(256) r(k)
  UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM bits WHERE step < 8),
crc_table AS (SELECT list(v ORDER BY k) AS t FROM bits WHERE step = 8),
crc AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS d, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, d, i + 1, xor(v // 256, t[xor(v % 256, ord(d[i + 1])) + 1]) FROM crc, crc_table WHERE i < length(d)),
odd AS (SELECT doc_id, xor(v, 4294967295) % 2 AS rest FROM crc WHERE i = length(d)),
leaves AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf, {_sql_leaf("replace(text, chr(10), '')")} AS other FROM documents),
nodes AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, 0 AS level, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, pos // 3, (any_value(n) + 2) // 3, any_value(level) + 1, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, pos // 3),
subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT pos, n, 0 AS level, subroot AS digest FROM subroots
  UNION ALL
  SELECT pos // 3, (any_value(n) + 2) // 3, any_value(level) + 1, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY pos // 3),
runs AS (
  SELECT source, level, pos // 3 AS parent, list(digest ORDER BY pos) AS run FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, pos // 3 AS parent, list(digest ORDER BY pos) AS run FROM upper WHERE n > 1 GROUP BY ALL),
heights AS (SELECT source, max(level) AS top FROM nodes GROUP BY source),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.source ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS pos,
    CASE WHEN o.rest = 0 AND l.other IS NOT NULL THEN l.other ELSE l.leaf END AS start, row_number() OVER () AS nth
  FROM leaves l LEFT JOIN odd o ON l.doc_id = o.doc_id),
steps AS (
  SELECT r.nth, u.level AS step, u.run, (r.pos // CAST(3 ** u.level AS BIGINT)) % 3 AS i
  FROM ranked r JOIN runs u ON u.source IS NOT DISTINCT FROM r.source AND u.parent = r.pos // CAST(3 ** (u.level + 1) AS BIGINT)
  UNION ALL
  SELECT r.nth, h.top + u.level, u.run, (s.pos // CAST(3 ** u.level AS BIGINT)) % 3
  FROM ranked r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source JOIN heights h ON h.source IS NOT DISTINCT FROM r.source
    JOIN upper_runs u ON u.parent = s.pos // CAST(3 ** (u.level + 1) AS BIGINT)),
sides AS (SELECT nth, step, array_to_string(run[1:i], '') AS lefts, array_to_string(run[i + 2:], '') AS rights FROM steps),
proofs AS (SELECT nth, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof FROM sides GROUP BY nth),
folds AS (
  SELECT nth, start AS digest, 0 AS step FROM ranked
  UNION ALL
  SELECT f.nth, sha256(s.lefts || f.digest || s.rights), f.step + 1 FROM folds f JOIN sides s ON s.nth = f.nth AND s.step = f.step),
folded AS (SELECT nth, arg_max(digest, step) AS folded_root FROM folds GROUP BY nth)
SELECT r.doc_id, r.leaf, s.subroot, u.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = u.digest AS verified
FROM ranked r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source JOIN folded f ON f.nth = r.nth LEFT JOIN proofs p ON p.nth = r.nth, (SELECT digest FROM upper WHERE n = 1) u
"""
