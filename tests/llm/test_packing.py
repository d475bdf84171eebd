import zlib

import numpy as np
import pytest
from tidemark.llm import packing
from tidemark.llm.queries import op1_power_of_two_packing

TEXTS = ["", None, "Hello world", "two  spaces and\ttab \nnew  ", " lead", "trail ", "don't STOP here 漢字 123 <|endoftext|> x", "a " * 5000, "word" * 9000, "\n\n a \n b", "x y  z", "it's they'll 's  's", "<|endoftext|>", "hello <|endoftext|> world", "a<|endoftext|>  <|endoftext|>b <|endoftext|"]


def plain(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_files()[0])
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_tokenizers(spark):
    fast = packing.Encoder(*packing.tokenizer_files())
    sample = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    for t in [*TEXTS, *sample]:
        assert np.frombuffer(fast.packed(t or ""), "<u4").tolist() + [1] == plain(t)


def test_added_tokens_keep_their_id():
    fast = packing.Encoder(*packing.tokenizer_files())
    assert np.frombuffer(fast.packed("hello <|endoftext|> world"), "<u4").tolist() == [31373, 220, 50256, 995]


def test_round_trip(spark, tmp_path):
    rows = [(i, t, 3) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 3), (None, "no id", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = op1_power_of_two_packing(spark, str(tmp_path)).collect()
    with_ids = packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert len(out) == len(with_ids) and len({r.sequence_id for r in out}) == len(out)
    for i, t in enumerate(TEXTS):
        if i == 2:
            continue
        own = sorted((r for r in with_ids if r.doc_id == i), key=lambda r: r.start)
        want = plain(t)
        assert [x for r in own for x in r.ids] == want and all(r.doc_tokens == len(want) for r in own)
        for r in own:
            assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.length == len(r.ids) == 1 << r.bucket
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_lengths():
    assert packing.lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.lengths(0, 2048) == []
    with pytest.raises(ValueError):
        packing.pack(None, max_len=3)


def test_buckets_on_disk_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    packing.write_buckets(packing.pack(df), f"{tmp_path}/out")
    assert {r.bucket for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {2}
    assert packing.pack(df.limit(0)).collect() == []
