"""Sharding, the Merkle manifest and lexical search against brute force, on given and awkward rows."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import lexical, merkle, sharding

WIDE = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, _m int, size string, hash string, `a.b` int"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "l", s, None if t is None else len(t), "x", 1, 2, "y", "z", 3) for i, t, s in rows], WIDE)


AWKWARD = [(1, "same words", "s"), (1, "same words", "s"), (None, None, None), (None, "", None), (2, " \n ", "s"), (3, "x" * 300_000, "t"), (None, "é🎉\nÀb", "t"), (4, "tie one", "s"), (5, "tie one", "s"), (-7, None, "")]


# --- op11 -----------------------------------------------------------------------------------------


def check_shards(rows, shards, slack):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for held in by.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    loads = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    assert max(loads) - min(loads) <= slack, (min(loads), max(loads))


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_even_and_whole_groups_stay(spark, shards):
    rng = random.Random(shards)
    texts = ["hot text " * 3] * 1000 + [f"{k} " + "w" * rng.randrange(200) for k in range(1500)] + ["pair " + str(k % 100) for k in range(300)] + ["z" * 4000 + str(k) for k in range(9)]
    rng.shuffle(texts)
    rows = wide(spark, [(k, t, "s") for k, t in enumerate(texts)])
    found = sharding.assign(sharding.measured(rows), shards).collect()
    sizes = {k: len(t) + 16 for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["size"] for r in found} == sizes
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in found)
    share = sum(sizes.values()) / shards
    check_shards(found, shards, max(4100, share / sharding.GRAIN * 2))
    homes, size = {}, Counter()
    for r in found:
        homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        size[texts[r["doc_id"]]] += r["size"]
    assert all(len(s) == 1 for t, s in homes.items() if size[t] <= share)
    again = sharding.assign(sharding.measured(rows), shards).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in found}


def test_equal_rows_that_fill_a_third_are_dealt_out(spark):
    rows = wide(spark, [(5, "the same row", "s")] * 2000 + [(k, f"text {k}", "s") for k in range(4000)])
    check_shards(sharding.assign(sharding.measured(rows), 10).collect(), 10, 6000 * 30 / 10 / sharding.GRAIN * 2)


def test_shards_of_awkward_rows(spark, tmp_path):
    docs = wide(spark, AWKWARD)
    found = sharding.assign(sharding.measured(docs), 4).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found) == sorted((i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in AWKWARD)
    check_shards(found, 4, 300_016)
    assert sharding.assign(sharding.measured(docs.limit(0)), 4).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(docs.columns)
    plain = lambda rows: sorted(repr((r["doc_id"], r["text"], r["source"], r["a.b"], r["size"])) for r in rows)
    assert plain(back.collect()) == plain(docs.collect())
    places = sorted((r["shard"], r["slot"]) for r in back.select("shard", "slot").collect())
    assert places == sorted((r["shard"], r["slot"]) for r in found)


def test_heavy_units_go_to_the_least_loaded(spark):
    rng = random.Random(3)
    sizes = sorted((rng.randrange(1, 10**6) for _ in range(200)), reverse=True)
    got = sharding.deal_heavy(spark.createDataFrame([(k + 1, s) for k, s in enumerate(sizes)], "_unit long, _size long").repartition(3), 9).first()
    load, at = [0] * 9, []
    for s in sizes:
        at.append(load.index(min(load)))
        load[at[-1]] += s
    assert (got["load"], got["at"]) == (load, at)


def test_room_and_search(spark):
    for loads, rest in [([0, 0, 0], 9), ([10, 0, 2], 4), ([5, 5], 0), ([100, 1, 1], 10), ([0], 7)]:
        got = sharding.room(loads, rest)
        assert math.isclose(sum(got), rest)
        level = max((a + b for a, b in zip(loads, got) if b), default=0)
        assert all(math.isclose(a + b, level) if b else a >= level - 1e-9 for a, b in zip(loads, got))
    values = [-5, 0, 0, 3, 9, 9, 40]
    from pyspark.sql import functions as F

    rows = spark.range(-10, 50).select("id", sharding.last_not_above(values, F.col("id")).alias("n")).collect()
    assert all(r["n"] == bisect.bisect_right(values, r["id"]) for r in rows)


def test_overfull_ranges_are_subdivided(spark):
    from pyspark.sql import functions as F

    keyed = spark.range(20_000).select(F.col("id").alias("_m"), F.when(F.col("id") < 6000, 77).otherwise(F.col("id")).alias("_key"), F.when(F.col("id") == 9000, 50_000).otherwise(1).cast("long").alias("size"))
    bounds = sharding.splitters(keyed, 100.0)
    held = Counter()
    for r in keyed.collect():
        held[bisect.bisect_right(bounds, r["_key"])] += r["size"]
    keys = {r: len({k["_key"] for k in keyed.collect() if bisect.bisect_right(bounds, k["_key"]) == r}) for r, b in held.items() if b > 800}
    assert all(n == 1 for n in keys.values()) and len(keys) == 2


# --- op12 -----------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), r))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    def path(levels, k):
        for level in levels[:-1]:
            first = k // 3 * 3
            yield level[first:k], level[k + 1 : first + 3]
            k //= 3

    trees = {s: tree([x[2] for x in sorted(held, key=lambda x: x[:3])]) for s, held in by.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in names])
    for nth, s in enumerate(names):
        for k, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            now, proof = leaf, [*path(trees[s], k), *path(top, nth)]
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = h(*map(field, (*r[:4], r[4].replace("\n", ""))))
            for left, right in proof:
                now = h(*left, now, *right)
            yield r[0], leaf, trees[s][-1][0], top[-1][0], h(*[x for a, b in proof for x in a + b]), now, now == top[-1][0]


def manifest_rows(docs):
    found = merkle.manifest(docs, merkle.tampered())
    return sorted(map(repr, (tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in found.collect())))


@pytest.mark.parametrize("seed", range(3))
def test_manifest_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    # one source of many blocks and rounds, one just over a block, one leaf, the null source, names whose bytes sort unlike their letters
    sizes = {"hot": 5000 + seed, "b": 2188, "lone": 1, None: 7, "é": 3, "Z": 9, "a": 10, "": 4}
    rows = [(k, s, rng.choice(["en", None]), k % 5, rng.choice([None, "", "a\nb", f"line {k}\n", "plain"])) for s, n in sizes.items() for k in rng.sample(range(9999), n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest_rows(docs) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_awkward_rows(spark):
    docs = wide(spark, AWKWARD)
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert manifest_rows(docs) == sorted(map(repr, plain_manifest(rows)))
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == one[0]["folded_root"] and one[0]["proof_sha256"] == h("")


def test_paths_prove(spark):
    rows = [(k, str(k % 3), None, 1, f"text {k}") for k in range(200)]
    for r in merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), paths=True).collect():
        assert merkle.fold(r["leaf"], merkle.linked(r["path"])) == r["root"] and merkle.fold("0" * 64, merkle.linked(r["path"])) != r["root"]
        assert r["proof_sha256"] == h(*r["path"]) and merkle.flat(merkle.linked(r["path"])) == r["path"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_labels_stand_in_order(n):
    top = merkle.height(n)
    made = merkle.send_up([str(k) for k in range(n)], top)
    for level in range(top):
        for k in range(len(made[level])):
            assert merkle.label(level, k, n) < merkle.label(level + 1, k // 3, n)
    assert [k for k, _ in merkle.send_down(made, ())] == list(range(n))[::-1]


# --- op13 -----------------------------------------------------------------------------------------

TERM = re.compile(lexical.TERM)
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def plain_search(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        w = {t: math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        scored = []
        for doc, bag in bags:
            m = 50 + 50 * sum(bag.values()) * len(bags) // total
            score = sum(w[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in w if t in bag)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, nth, d if known else None, -s) for nth, (s, known, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def found_rows(docs, items, k):
    return sorted(map(repr, (tuple(r) for r in lexical.search(lexical.build(docs), items, k).select("item_id", "rank", "doc_id", "score").collect())))


@pytest.mark.parametrize("seed,parts", [(0, 1), (1, 3), (2, 40)])
def test_search_equals_brute_force(spark, seed, parts):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)] + ["É", "é", "ÀB", "日本"]
    docs = [(k, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=int(rng.paretovariate(0.8)) % 900))) for k in range(700)]
    docs += [(1000 + k, docs[5][1]) for k in range(90)] + [(2000, None), (2001, ""), (2002, "?! -")]
    items = [(k, " ".join(rng.choices(words, k=12)).upper()) for k in range(30)] + [(3, "w1 w2"), (99, None), (98, "nowhere-else")]
    spread = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    assert found_rows(spread, spark.createDataFrame(items, "item_id long, text string"), 20) == plain_search(docs, items, 20)


def test_search_of_awkward_rows(spark):
    docs = wide(spark, AWKWARD)
    items = spark.createDataFrame([(1, "TIE same É🎉"), (None, "tie"), (2, "")], "item_id long, text string").selectExpr("item_id", "text", "1 as term", "2 as w", "'q' as doc_id")
    want = plain_search([(i, t) for i, t, _ in AWKWARD], [(1, "TIE same É🎉"), (None, "tie"), (2, "")], 5)
    assert found_rows(docs, items, 5) == want
    assert found_rows(docs.limit(0), items, 5) == [] == found_rows(docs, items.limit(0), 5)


def test_terms_of_texts():
    texts = [None, "", "Ab-c", "D", " é9 ", "x" * 5000, "Z\x00z\x7fÀ", "end"]
    words, doc = lexical.terms_of(pa.array(["skipped", *texts])[1:])
    want = [(k, w) for k, t in enumerate(texts) for w in TERM.findall((t or "").translate(LOWER))]
    assert list(zip(doc.tolist(), words.to_pylist())) == want


def test_strata_below_the_bound_are_not_visited():
    rng = np.random.default_rng(5)
    m = np.sort(rng.integers(50, 90, 3000))
    ids, hashes = list(range(3000)), np.zeros(3000, np.int64)
    terms = []
    for t in range(6):
        docs = np.flatnonzero(rng.random(3000) < 0.3)
        tfs = rng.integers(1, 9, len(docs))
        order = np.lexsort((docs, tfs, m[docs]))
        terms.append((docs[order], tfs[order], [(0, 10 * t + 1), (1, 5)]))
    for k, floors in ((1, {}), (10, {}), (4000, {}), (10, {0: 20_000_000})):
        got = list(lexical.score_unit(ids, hashes, m, terms, floors, k))
        for item in (0, 1):
            scores = np.zeros(3000, np.int64)
            for docs, tfs, users in terms:
                scores[docs] += dict(users)[item] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[docs]))
            least = max(1, floors.get(item, 1))
            want = sorted(((-int(s), d) for d, s in enumerate(scores) if s >= least))[:k]
            assert [(-s, d) for i, d, s in got if i == item] == want
