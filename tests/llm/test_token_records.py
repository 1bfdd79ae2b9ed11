import io
import zlib

import numpy as np
import pytest

from beaconry.llm import token_records as t

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "A b C d", "x<|endoftext|>y <|startoftext|>", "éa É. Straße STRASSE ΑΣ ΣΑΣ İx", "it's I'll don't 'tis a.b.c 12,3 ½", "\x1c\x1d a\x85b\tc\r\nd", "ÿ. Ÿ! ×÷ µ ª º", "日本語 テスト。", "é ä. ño", "İ.ǅ", "w" * 5000]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows] + [(1000 + i, x) for i, x in enumerate(ODD)] + [(2000, None), (2000, None), (None, "no id")]


def test_read_back_like_whole_encoding(spark, whole):
    rows = texts(spark)
    out = t.tokenized(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard long").repartition(3), PATH)
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[1])
    assert len(got) == len(rows)
    start = 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(whole(text) + [1], "<u4")
        row = got.pop(0)
        assert row == (doc_id, start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)


def test_shuffled_reads_give_the_same_records(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(50)], "doc_id long, text string")
    manifest = t.write_records(docs, str(tmp_path / "r"), t.ChunkEncoder(PATH, 1), shard_bytes=300)
    assert manifest.count() > 3
    inorder, mixed = t.read_records(spark, manifest).collect(), t.read_records(spark, manifest, seed=3).collect()
    assert {(r["doc_id"], tuple(r["ids"])) for r in inorder} == {(r["doc_id"], tuple(r["ids"])) for r in mixed}
    assert [r["doc_id"] for r in mixed] != [r["doc_id"] for r in inorder]
    assert sorted(r["start"] for r in inorder)[0] == 0


def test_damage_is_found():
    raw = t.framed(t.serialized(7, np.array([1, 2, 3]), 2))
    assert t.parsed(t.unframed(io.BytesIO(raw)))[1].tolist() == [1, 2, 3]
    assert t.unframed(io.BytesIO(b"")) is None
    for at in (0, 9, 20, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(t.BadRecord):
            t.unframed(io.BytesIO(bytes(bad)))
    with pytest.raises(t.BadRecord):
        t.unframed(io.BytesIO(raw[:-2]))


def test_wide_ids_and_null_ids():
    doc_id, ids = t.parsed(t.serialized(None, np.array([70_000]), 4))
    assert doc_id is None and ids.tolist() == [70_000]


def test_empty_table(spark):
    assert t.tokenized(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
