import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import queries, token_binary, token_counts
from tests.llm import docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOL = ["ab" * 40, " ", "  ", "<|endoftext|>", "é", "中", "\n", "\n\n", "\t", "'ll", "'", "s", "12", "the", "ing", ".", "\xa0", " a", "x" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(POOL, k=rng.randint(0, 12))) for _ in range(n)]


def test_heap_merging_counts_as_the_library(library):
    count = token_counts.counter(PATH)
    for t in texts(1500, 1):
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_memoised_ids_are_the_library_s(library):
    encode = token_binary.encoder(PATH)
    for t in texts(3000, 2):
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_that_begin_with_a_known_chunk(library):
    """Words alone, before and after forms of them with signs, contractions, digits and line ends, in a small memo too."""
    rng = random.Random(3)
    ends = ["", ",", "'s", "'ll", ".\n", "12", "-ing", "\xa0x", "'", "é"]
    for memo in (600_000, 3):
        encode = token_binary.encoder(PATH, memo)
        for _ in range(400):
            t = " ".join(rng.choice(["the", "Ndedti", "erü", "12", "'", "I", "ª"]) + rng.choice(ends) for _ in range(rng.randint(1, 9)))
            assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_counts_of_awkward_rows(spark, library):
    got = token_counts.token_counts(docs.table(spark), PATH).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in docs.ROWS]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert {r.over_limit for r in got if r.n_tokens > 1024} == {True}
    assert token_counts.token_counts(docs.empty(spark), PATH).count() == 0


def test_variable_length_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_binary.pack(v)
        assert (token_binary.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()
        assert len(control) == -(-n // 4)


def test_ranks_follow_frequency():
    ids = np.array([7, 7, 7, 3, 3, 9, 5, 5], np.uint32)
    ranks, names = token_binary.rank_by_frequency(ids)
    assert names.tolist() == [7, 3, 5, 9] and (names[ranks] == ids).all()


def test_token_files_round_trip(spark, library, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_binary.write_token_files(docs.table(spark), path, PATH, file_tokens=2000)
    got = token_binary.read_token_files(spark, path, with_ids=True).collect()
    want = {}
    for doc_id, text, *_ in docs.ROWS:
        want.setdefault(doc_id, []).append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    for r in got:
        ids = list(r.ids)
        assert ids in want[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert len(got) == len(docs.ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert named == sorted(named)


def test_token_files_of_an_empty_table(spark):
    assert token_binary.token_files(docs.empty(spark), PATH).count() == 0


def test_op2_against_brute_force(spark, small, library):
    got = {r.doc_id: r for r in queries.op2_token_files(spark, small).collect()}
    start = 0
    for r in sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op1_against_the_library(spark, small, library):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op1_token_counts(spark, small).collect():
        assert r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(text[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024)
