"""Registered queries of the subpackage against their SQL and contract, and the pipeline's stages on given and awkward rows."""

import pytest
from helpers import same

import corpus_pipeline
from codeloom.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_mips": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_kd_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op11_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op12_merkle": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op13_lexical": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ORACLE_SQL])
def test_contract(spark, sf, name):
    found = QUERIES[name](spark, sf)
    types = dict(found.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = found.toPandas()
    if "doc_id" in rows:
        ids = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").toPandas()["doc_id"]
        assert sorted(rows["doc_id"]) == sorted(ids)
    if name in ("op5_toxicity", "op6_language"):
        import zlib

        assert rows["score"].between(0, 1).all()
        assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["doc_id"]]).all()
    if name == "op5_toxicity":
        assert (rows["predicted"] == (rows["score"] >= 0.7)).all()
    if name == "op1_mips":
        assert (rows["query_id"] % 20 == 0).all() and (rows.groupby("query_id").size() == 20).all()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.stored(stage(spark, docs, sf), name)
        assert docs.columns == names
        sizes.append(docs.count())
    assert 200 >= sizes[0] > sizes[1] == sizes[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == sizes[3]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rest string, toxicity double, _th long, `a.b` int, kept string"
PROSE = " ".join(f"word{k} of" for k in range(60))


def awkward(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "r", 0.5, 7, 1, "k") for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(spark, sf, name, stage):
    rows = [(1, PROSE, "s"), (1, PROSE, "s"), (2, None, None), (None, None, "s"), (None, "", None), (3, "", "s"), (4, " \n", "s"), (5, "one two " * 30_000, "t"), (None, "é🎉\x00 x", "t"), (6, PROSE[:300] + " end", "t")]
    docs = awkward(spark, rows)
    out = stage(spark, docs, sf)
    assert name == "bpe" or out.columns == docs.columns
    found = out.collect()
    assert {r["doc_id"] for r in found} <= {i for i, _, _ in rows} and len(found) >= (7 if name != "mixing" else 1)
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_one_row_of_a_group_stays(spark, sf):
    other = "another text altogether, with words of its own"
    rows = [(1, PROSE, "s"), (5, other, "s"), (5, PROSE + " extra", "s"), (None, PROSE + " more", "s"), (None, "third " + other[::-1], "s"), (5, other, "s")]
    found = corpus_pipeline.near_dedup_stage(spark, awkward(spark, rows), sf).collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in found)) == sorted([(1, PROSE), (5, other), (0, rows[4][1])])
