"""What Python workers hold between tasks and stages."""

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import huffman, suffix_dedup


# --- op2 ------------------------------------------------------------------------------------------


def test_pieces_of_long_texts_are_fetched_in_bounded_batches():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 3_000_000, 900, 2_000_000)]
    wanted = [[{"anchor": k * 1_000_000 + a, "fp": -a, "first": a, "last": a + 100, "extra": 200, "side": a % 3 - 1} for a in range(0, len(t) - 300, 100)] for k, t in enumerate(texts)]
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("fp", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("extra", pa.int32()), ("side", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(wanted, kind)], names=["text", "wanted"])
    got = list(suffix_dedup._slices([batch, batch.slice(2, 1), batch.slice(0, 1)]))
    assert max(b["piece"].nbytes for b in got) < 3 << 20
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    one = lambda k: [(w["anchor"], w["fp"], w["side"], texts[k][w["first"] : w["last"] + w["extra"]]) for w in wanted[k]]
    assert rows == [*one(0), *one(1), *one(2), *one(3), *one(2), *one(0)]


# --- op8 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("later", [huffman._counts, huffman._pack_blocks(np.ones(2, np.int64)), huffman._as_checks(np.ones(2, np.int64))])
def test_stages_after_the_encoding_give_up_the_encoder(later):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one text", "another text"]})
    first = list(huffman._tokenize(path)([texts]))
    assert path in huffman._encoders
    list(later(iter([])))
    assert not huffman._encoders
    again = list(huffman._tokenize(path)([texts]))
    assert [b.to_pydict() for b in again] == [b.to_pydict() for b in first]
