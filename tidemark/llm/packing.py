"""Power-of-two packing of tokenised documents.

A document of n ids is cut into floor(n / max_len) pieces of ``max_len`` and the
binary decomposition of the rest, largest first. Every piece is a sequence of
its own, so that no sequence crosses documents and nothing is padded; pieces of
equal length share a bucket and can be batched together (``write_buckets``).

The work is one map over the rows: nothing is shuffled, and a lost task is
redone alone. Words are tokenised once per worker and remembered in a cache
that is emptied at ``CACHE`` entries.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Entries of a worker's word cache, about 100 MB.
CACHE = 400_000

SCHEMA = "doc_id long, piece int, start long, length long, bucket int, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_files() -> tuple[str, str]:
    """Places of the public byte-level vocabulary: for tokenizers, and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class WordIds(dict):
    """Little-endian 32-bit ids of ``" " + word``; None for a word whose neighbours matter.

    Byte-level pre-tokenisation starts a new pre-token at a lone space, so ids of
    space-separated words don't depend on each other. That doesn't hold next to
    other white space, where None sends the document down the whole-text path.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.clear()
        odd = not word or word[0].isspace() or word[-1].isspace()
        got = self[word] = None if odd else np.array(self.encode(" " + word), "<u4").tobytes()
        return got


class Encoder:
    """Ids as ``tokenizers`` gives them with add_special_tokens=False.

    Texts that hold the string of an added token go through ``tokenizers`` whole,
    as it gives that string its own id. With ``ranks_path``, the same vocabulary
    as ranks, all other words are encoded by the faster library; the ids are the same.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(json_path)
        self.whole = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.added = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or r"(?!)")
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.encode = self.whole
        self.words = WordIds(self.encode)

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.added.search(text):
            return np.array(self.whole(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            try:
                return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))
            except TypeError:  # a word is None
                pass
        return np.array(self.encode(text), "<u4").tobytes()


def lengths(n: int, max_len: int) -> list[int]:
    """Powers of two that add up to n, largest first, none above max_len."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, max_len: int = 2048, eos_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text).

    Null and empty texts give one piece that holds ``eos_id`` alone. Repeated
    rows are packed each for itself; a null doc_id stays null. Columns beside
    doc_id and text are not carried. ``ids`` is null without ``with_ids``.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    if not tokenizer_path:
        tokenizer_path, ranks_path = tokenizer_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, ranks_path)
        eos = np.array([eos_id], "<u4").tobytes()
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        made = 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = encoder.packed(text.as_py() or "") + eos
                n = len(blob) // 4
                at = 0
                for k, size in enumerate(lengths(n, max_len)):
                    part = blob[4 * at : 4 * (at + size)]
                    for col, v in zip(cols, (doc, k, at, size, size.bit_length() - 1, part if with_ids else None, zlib.crc32(part), n, task + made), strict=True):
                        col.append(v)
                    at += size
                    made += 1
                held += len(blob)
                if held > 8 << 20:
                    yield _rows(cols)
                    cols, held = [[] for _ in range(9)], 0
            if cols[0]:
                yield _rows(cols)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _rows(cols: list[list]) -> pa.RecordBatch:
    doc, piece, start, length, bucket, ids, crc, tokens, seq = cols
    n = len(doc)
    if ids[0] is None:
        lists = pa.nulls(n, pa.list_(pa.int32()))
    else:
        flat = np.frombuffer(b"".join(ids), "<i4")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(bucket, pa.int32()), lists, pa.array(crc, pa.int64()), pa.array(tokens, pa.int64()), pa.array(seq, pa.int64()), pa.array(np.zeros(n, np.int64))],
        names=["doc_id", "piece", "start", "length", "bucket", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences of equal length in a folder of their own, as batches want them."""
    packed.write.partitionBy("bucket").parquet(path)
