"""Files of token ids: blocks as an exact round trip, files against tokenizers."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import token_files as T
from saltmarsh.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 64, 127, 128, 129, 5000])
@pytest.mark.parametrize("most", [1, 2, 50_257, 2**32 - 1])
def test_blocks_come_back(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n, dtype=np.uint64).astype("<u4")
    for share in (0.01, 0.5, 0.9, 1.0):
        body, start = T.encode_blocks(ids, share)
        assert len(start) == -(-n // 128) and (T.decode_blocks(body, start, n) == ids).all()
    body, start = T.encode_blocks(ids)
    if n == 5000:  # any block alone
        assert (T.decode_blocks(body, start[7:8], 128) == ids[7 * 128 : 8 * 128]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(1280, 7, "<u4")
    ids[::128] = 2**32 - 1
    body, start = T.encode_blocks(ids)
    assert len(body) == 10 * (8 + 5) and (T.decode_blocks(body, start, 1280) == ids).all()
    with pytest.raises(ValueError):
        T.read_file(b"x" * 64)


def expected(rows, end=0):
    from tokenizers import Tokenizer

    encode, at, out = Tokenizer.from_file(vocabulary()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents_from_files(spark):
    got = sorted(map(tuple, T.op11_token_files(spark, SF).collect()))
    assert got == expected([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_odd_documents(spark):
    rng = random.Random(2)
    rows = [(i * 7 % 101, " ".join(rng.choice("abc 1é\n") * rng.randrange(4) for _ in range(rng.randrange(50)))) for i in range(101)]
    rows += [(500, None), (501, ""), (-4, "x"), (None, "no id"), (502, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(9), "ids": F.lit("mine"), "tie": F.lit(0)})
    for size in (1, 200, 1 << 20):
        files, bases = T.write_token_files(docs.repartition(5), file_ids=size)
        got = T.read_documents(files, bases).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)
    assert sum(len(r.ids) for r in T.read_ids(files).collect()) == sum(r.n_tokens for r in got)
    # Equal doc_ids, and equal rows: each is a document of its own, and places follow without a gap.
    many = spark.createDataFrame([(1, f"text {i % 3}") for i in range(300)] + [(2, "z")], "doc_id long, text string")
    got = sorted(T.read_documents(*T.write_token_files(many, file_ids=50)).collect(), key=lambda r: r.start)
    assert len(got) == 301 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[-1].doc_id == 2
    assert T.read_documents(*T.write_token_files(docs.limit(0))).count() == 0
