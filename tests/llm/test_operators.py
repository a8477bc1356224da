"""Dealt operators against brute force, round trips and held-out accuracy, with awkward rows."""

import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import anisotropic, bpe, common, components, huffman, kd_search, language_id, mixing, near_dedup, run_index, suffix_dedup, toxicity, warc

PASSAGE = " ".join(f"word{k}" for k in range(70))
TEXTS = [
    None, "", " ", "a", "one two", "One TWO", "x" * 450, "ab" * 300, f"left {PASSAGE} right", f"other {PASSAGE} end", PASSAGE, PASSAGE,
    PASSAGE + " more", " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(41)), "é" * 150 + "ñ" * 120, "ü" + "é" * 150 + "ñ" * 100,
    "\x00" * 260, "\x1c\x1d a  b \n\n c 日本語 🎉 <|endoftext|> it's", "long " * 3000,
]


def documents(spark, texts=TEXTS, source=lambda k: ["s1", "s2", None][k % 3]):
    rows = [(k if k != 3 else None, t, "en", source(k), len(t or ""), "x", "y") for k, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _kept string, toxicity string")


def empty(spark):
    return documents(spark).limit(0)


# --- suffix dedup ---------------------------------------------------------------


def without_repeats(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + window] for b in raw for p in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats_equal_brute_force(spark, hot):
    docs = documents(spark)
    got = suffix_dedup.remove_repeats(docs, 200, hot=hot, block=2000)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["kept", "n_bytes", "n_removed", "n_spans"]
    found = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect())
    assert found == sorted(without_repeats([*TEXTS, TEXTS[-1]], 200))


def test_clean_documents_keep_their_columns(spark):
    docs = documents(spark)
    out = suffix_dedup.clean_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 40, 90):
        text = np.tile(rng.integers(0, 3, n // 3 + 1), 3)[:n].astype(np.uint64)
        found = run_index.RunIndex(text).matching_statistics()
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert found[i] == best


def test_streamed_strings():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 200):
        text = rng.integers(97, 99, n)
        some = [bytes(rng.integers(97, 100, k).tolist()) for k in (0, 1, 1, 2, 3, 4, 7) for _ in range(8)]
        some += [bytes(text[k : k + 40].tolist()) for k in range(0, n, 9)]
        index = run_index.RunIndex(np.append(text, 256).astype(np.uint64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])])
        found = index.occur(np.frombuffer(b"".join(some), np.uint8), offsets)
        assert found.tolist() == [x in bytes(text.tolist()) for x in some]


def test_only_what_the_index_finds_counts():
    batch = pa.RecordBatch.from_pydict({"region": [4, 5, 6], "a": [b"xyz" * 90, b"abc" * 90, b""], "b": [b"xyz" * 90, b"abd" * 90, b""]})
    assert [b["region"].to_pylist() for b in suffix_dedup._found([batch, batch.slice(1, 1)])] == [[4, 6], []]


# --- near dedup -----------------------------------------------------------------


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return sorted(repr((i, len(sets[k]), c := least[find(k)], i == c)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 2])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = [f"t{k}" for k in rng.integers(0, 900, 160)]
    texts = list(TEXTS)
    for k in range(60):  # a chain and a crowd of near copies around the bound
        copy = list(base)
        for at in rng.choice(160, k // 6, replace=False):
            copy[at] = f"z{k}{at}"
        texts.append(" ".join(copy))
    docs = documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in near_dedup.groups(docs).drop("th", "first").collect()) == brute_groups(rows)
    assert near_dedup.groups(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "u long, v long")
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert all(found[k] == 0 for k in range(201)) and found[501] == 500


# --- vectors --------------------------------------------------------------------


def embeddings(spark, n=400, dim=12):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=dim)]) for k in range(n)]
    rows += [(n, None), (n + 20, []), (n + 40, [0.0] * dim), (n + 60, [float("nan")] + [1.0] * (dim - 1)), (n + 80, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim), (1, rows[1][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def usable_rows(rows, zero):
    out = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    return out if zero else [(i, v) for i, v in out if any(v)]


def test_inner_product_search_recall(spark):
    rows, frame = embeddings(spark)
    good = usable_rows(rows, False)
    hit = total = 0
    for q, group in anisotropic.search(frame, 20, 20).toPandas().groupby("query_id"):
        asked = np.array(dict(good)[q])
        want = sorted(((-float((np.array(v) * asked).sum()), i) for i, v in good if i != q))[:20]
        assert list(group.sort_values("rank")["rank"]) == list(range(1, 21))
        hit += len({i for _, i in want} & set(group.vec_id))
        total += 20
    assert hit / total >= 0.95
    assert anisotropic.search(frame.limit(0), 20, 20).count() == 0


def test_mips_ranks_equal_vectors_by_id(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [3.0] * 8 if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(1200)]
    rows += [rows[0], rows[3]] * 2  # repeated rows of a query and of a candidate
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for q, group in anisotropic.search(frame, 60, 20).toPandas().groupby("query_id"):
        # every query id is divisible by 3: its copies rank first, by id
        want = sorted(i for i, _ in rows if i % 3 == 0 and i != q)[:20]
        assert list(group.sort_values("rank")["vec_id"]) == want
    near = [(i, [3.0 + 1e-9 * i] * 8 if i % 3 == 0 else v) for i, v in rows[:1200]]  # other vectors, equal codes
    frame = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    for q, group in anisotropic.search(frame, 60, 20).toPandas().groupby("query_id"):
        want = [i for i in range(1197, 0, -3) if i != q][:20]
        assert list(group.sort_values("rank")["vec_id"]) == want


@pytest.mark.parametrize("noise", [0.3, 0.01, None])
def test_mips_recall_on_full_shards(spark, noise):
    rng = np.random.default_rng(9)
    n, dim = 40_000, 16
    x = rng.normal(size=(n, dim))
    if noise:  # ten clusters
        x = rng.normal(size=(10, dim))[rng.integers(10, size=n)] + noise * x
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x, hits = x.astype(float), []
    for q, group in anisotropic.search(frame, 1000, 20).toPandas().groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(set(np.argsort(-score)[:20]) & set(group.vec_id)) / 20)
    assert len(hits) == 40 and np.mean(hits) >= 0.99


def test_salted_join_of_a_hot_key(spark):
    left = spark.range(6000).selectExpr("id", "if(id % 3 = 0, id, 7) AS k")
    right = spark.range(5000).selectExpr("id AS k", "id * 2 AS v")
    found = common.salted_join(left, right, "k", "id").collect()
    assert len(found) == 6000 and all(r["v"] == (2 * r["k"] if r["k"] < 5000 else None) for r in found)
    assert common.salted_join(left, right, "k", "id", "inner").count() == sum(r["v"] is not None for r in found)


def test_kd_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr("codeloom.llm.vector_blocks.Deal.__init__.__defaults__", (100, 4))
    monkeypatch.setattr(kd_search, "LEAF", 16)
    rows, frame = embeddings(spark)
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in usable_rows(rows, True)]
    vec = dict(good)
    want = set()
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        best = sorted((-int(v @ vec[q]), i) for i, v in good if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in kd_search.search(frame, 50, 5).collect()} == want
    huge = spark.createDataFrame([(0, [1e18, 1.0]), (50, [1e18, -1.0])], "vec_id long, embedding array<double>")
    assert {r["score"] for r in kd_search.search(huge, 50, 5).collect()} == {2**63 - 1}
    assert kd_search.search(frame.limit(0), 50, 5).count() == 0


# --- learnt models --------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    bad, rows, labels = ["vile", "rotten", "nasty"], [], []
    for k in range(900):
        words = [f"w{x}" for x in rng.integers(0, 300, 30)]
        toxic = k % 5 == 0
        if toxic:
            words[3:5] = rng.choice(bad, 2)
        rows.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "vile " * 20000), (None, "rotten nasty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (1, None)], "doc_id long, toxic int"))
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(scores[k] >= 0.7) == (k % 5 == 0) for k in held]) > 0.97
    assert scores[2000] == scores[2001] < 0.7 <= scores[None]
    nothing = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["toxicity"] for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_toxicity_features_equal_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 40)
    texts = [None, "", "Vile viler VILEST vile!", "ünïcode_word ünïco ünïcorn 12345 1234", "x" * 100 + " tail tails", "a b c", "stem stems stemmed stemming " * 3]
    word = re.compile(r"\w+")
    want = []
    for k, t in enumerate(texts):
        count = Counter(f for w in set(word.findall((t or "").lower())) for f in [("=", w), *((n, w[:n]) for n in (4, 5, 6) if len(w) >= n)])
        want += [(k, level) for c in count.values() for level in (1, 2, 4) if c >= level]
    doc, keys = toxicity.text_features(texts)
    assert Counter(zip(doc.tolist(), (1 << (keys & np.uint64(3)).astype(int)).tolist())) == Counter(want)
    # equal features have equal hashes, different ones don't
    both = Counter()
    for k, t in enumerate(texts):
        both.update({(n, b, level) for level in (1, 2, 4) for (n, b), c in Counter(f for w in set(word.findall((t or "").lower())) for f in [("=", w), *((n, w[:n]) for n in (4, 5, 6) if len(w) >= n)]).items() if c >= level})
    assert sorted(Counter(keys.tolist()).values()) == sorted(both.values())
    some = np.unique(keys)[::3]
    d, at = toxicity.text_features(texts, toxicity.Lookup(some))
    assert sorted(zip(d.tolist(), some[at].tolist())) == sorted((x, y) for x, y in zip(doc.tolist(), keys.tolist()) if y in set(some.tolist()))


@pytest.mark.parametrize("bias,sign", [(1.0, 1), (-6.0, -1)])
def test_risk_equals_its_definition(bias, sign):
    rng = np.random.default_rng(6)
    n, prior = 5, 0.4 if sign < 0 else 0.1
    pack = lambda rows: toxicity._distinct([np.flatnonzero(r).astype("<u2").tobytes() for r in rows])
    p = rng.random((30, n)) < (0.1 if sign < 0 else 0.5)
    u = np.zeros((40, n), bool) if sign < 0 else rng.random((40, n)) < 0.3
    theta = np.append(rng.random(n) * (9 if sign < 0 else 1), bias)
    loss = lambda z: np.log1p(np.exp(-z))

    def parts(t):
        zp, zu = p @ t[:-1] + t[-1], u @ t[:-1] + t[-1]
        return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()

    plus, minus, grad = toxicity.risk(theta, pack(p), pack(u), prior)
    assert np.allclose((plus, minus), parts(theta)) and np.sign(minus) == sign
    step = lambda t: sum(parts(t)) if sign > 0 else -parts(t)[1]
    want = [(step(theta + e) - step(theta - e)) / 2e-6 for e in np.eye(n + 1) * 1e-6]
    assert np.allclose(grad, want, atol=1e-6)


def test_language_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["eau", "oui", "ré", "ent"]}
    rows = []
    for k in range(300):
        lang = sorted(parts)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(12)), lang))
    rows += [(900, None, "aa"), (901, "123 !", "bb"), (902, "katomi " * 90000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.identify(docs, language_id.train(docs)).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([found[i][0] == lang for i, _, lang in held]) > 0.98
    assert found[900] == found[901] == ("und", 0.0) and found[902][0] == "aa"
    none = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_language_probabilities_sum_to_one():
    model = language_id.Models({"x": language_id.fit(["abra cadabra abracadabra", "banana bandana"])})
    letters = sorted(set("abracadabra banana bandana"))
    for start in ("abra", "bana", "qqqq"):
        total = sum(float(np.exp(model._chars(np.frombuffer((start + c).encode("utf-32-le"), np.uint32))[-1, 0])) for c in letters)
        assert total <= 1.0 + 1e-6 and (start == "qqqq" or total > 0.85)


# --- mixing ---------------------------------------------------------------------


def test_mix_meets_targets(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source"], r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) <= 1 and target <= 2 * size for (_, size, target), t in by.items())
    total = sum(s for _, s, _ in by)
    assert abs(sum(t for _, _, t in by) - 1.5 * total) < 1e-6 * total
    assert mixing.mix(empty(spark)).count() == 0


def test_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "a b  c d", "s", 8), (2, "", "s", 0), (3, "x y", "s", 3)], "doc_id long, text string, source string, n_chars long")
    plan = spark.createDataFrame([(1, 4, 7), (2, 0, 0), (3, 2, 0)], "doc_id long, size long, taken long").join(docs.select("doc_id", common.text_key().alias("_th")), "doc_id")
    assert sorted(tuple(r) for r in mixing.repeat_documents(docs, plan).collect()) == [(1, "a b  c", "s", 6), (1, "a b  c d", "s", 8), (2, "", "s", 0)]


def test_repeated_documents_of_one_id(spark):
    rows = [(7, "a b c"), (7, "d e"), (None, "f g h i"), (None, "j"), (7, "d e"), (1, None), (1, "")]
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    want = sum(r["taken"] for r in mixed.collect())
    out = mixing.repeat_documents(docs, mixed).collect()
    assert sum(len((r["text"] or "").split()) for r in out) == want == 18  # 150 % of 12 words
    assert {(r["doc_id"], (r["text"] or "")[:1]) for r in out} <= {(i, (t or "")[:1]) for i, t in rows}
    assert sum(r["doc_id"] == 1 for r in out) == 2


# --- tokens ---------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*TEXTS, "ΟΔΥΣΣΕΥΣ Σ", "İstanbul", "é ﬁ", "aaaaaaaaaaaaaaaa" * 9, "It'S 12345 we'll"]
    docs = documents(spark, texts)
    for r in bpe.decode(bpe.encode(docs.withColumn("raw", docs["text"]), path), path).collect():
        want = library.encode(r["raw"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty(spark), path).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = documents(spark, [*TEXTS, "a  b   c", " lead", "trail  ", " \n \t q", "b 　c"])
    huffman.write_ids(docs, path, f"file://{tmp_path}/ids")
    got = sorted(((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in huffman.read_ids(spark, f"file://{tmp_path}/ids").collect()), key=lambda x: x[0])
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at, want = 0, []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((at, i, ids))
        at += len(ids)
    assert got == want
    checks = {r["start"]: r["ids_crc32"] for r in huffman.read_checks(spark, f"file://{tmp_path}/ids").collect()}
    assert checks == {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for s, _, ids in want}


@pytest.mark.parametrize("counts", [[5], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128], list(range(1, 300)), [0, 0, 7, 0, 1]])
def test_code_lengths(counts):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, 9)
    used = lengths[lengths > 0]
    assert (lengths > 0).tolist() == (counts > 0).tolist() and used.max() <= 9 and (0.5 ** used.astype(float)).sum() <= 1
    rng = np.random.default_rng(0)
    ids = rng.choice(np.flatnonzero(counts), 3000)
    bits, offsets = huffman.pack(ids, huffman.canonical_codes(lengths), lengths)
    each = np.diff(np.concatenate([np.arange(0, 3000, huffman.STRIDE), [3000]]))
    assert (huffman.Decoder(lengths).unpack(np.frombuffer(bits, np.uint8), offsets, each) == ids).all()


def test_empty_token_files(spark, tmp_path):
    import public_tokenizers

    huffman.write_ids(empty(spark), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/ids")
    assert huffman.read_ids(spark, f"file://{tmp_path}/ids").count() == 0


# --- WARC -----------------------------------------------------------------------


def test_archives(spark, tmp_path):
    long = "<p>é WARC/1.1\r\n\r\n</p>" * 90
    rows = [(1, "u1", long), (2, "u2", long), (5, "u\r\n5", long), (3, None, "short"), (4, "u4", "short"), (6, "u6", None), (7, "u7", ""), (None, "u8", long), (5, "u5", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    found = {tuple(r) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = {(i, len((h or "").encode()), sha(h), "revisit" if h == long and i != 5 else "response", 5 if h == long and i != 5 else None) for i, _, h in rows}
    assert found == want
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert raw.count(long.encode()) == 2 and raw.startswith(b"WARC/1.1\r\n")
    assert re.search(rb"WARC-Date: 20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", raw)
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("most", [600_000, 40])
def test_pieces_equal_the_library(most):
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), huffman.PieceEncoder(path, most)
    rng = np.random.default_rng(8)
    signs = [" ", " ", " ", "\n", "\t", "\r", "'", "s", "ll", "re", "A", "z", "é", "×", "²", "7", ".", "$", "—", "’", " ", "　", "日", "\x00", "\x1c", "\x85", "🎉", "_", "ǅ", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 60), p=np.array([4] * 3 + [1] * 26 + [0.1]) / 38.1)) for _ in range(3000)] + [*TEXTS, "", None]
    for a in range(0, len(texts), 500):
        some = texts[a : a + 500]
        ids, sizes = encoder.encode(pa.array(some))
        ends = np.cumsum(sizes)
        for t, end, n in zip(some, ends, sizes):
            assert ids[end - n : end].tolist() == library.encode(t or "", add_special_tokens=False).ids + [0]
    assert encoder.encode(pa.array([None, ""]))[1].tolist() == [1, 1]


def test_archives_of_a_hot_payload_and_a_long_page(spark, tmp_path):
    long = "<p>hot</p>" * 150
    rows = [(k, "u", long) for k in range(1500)] + [(5000 + k, "u", f"page {k} " * 200) for k in range(300)] + [(9000, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w", file_bytes=1 << 20)
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert found == {k: ("revisit", 1499) if k < 1499 else ("response", None) for k, _, _ in rows}
    # about file_bytes a file: one long page doesn't make one file for each record
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) <= 8 and max(sizes) < 3_000_000 + (4 << 20)
