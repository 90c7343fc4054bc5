"""Token codes: exact round trips of the code and of documents written and read back."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleanframe.llm import token_codes as module
from gleanframe.llm.token_codes import Codes, Memo, Shard, _tokenizer, default_vocabulary, encode, pack_shard, token_codes
from tests.llm.helpers import docs


def test_every_id_reads_back_at_random():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 200), [0, 255, 256, 65535, 65536, 2**32 - 1]])
    ids = rng.permutation(ids).astype(np.uint32)
    for bits in (8, 16):
        shard = Shard(pack_shard(ids, [5, None, 7], np.array([1000, 0, len(ids) - 1000]), bits))
        assert (shard.ids() == ids).all()
        assert all(shard.at(int(i)) == ids[i] for i in rng.integers(0, len(ids), 500))
        assert shard.doc_ids == [5, None, 7] and list(shard.starts) == [0, 1000, 1000, len(ids)]
        assert (shard.document(0) == ids[:1000]).all() and len(shard.document(1)) == 0


def test_small_ids_take_one_level():
    levels = encode(np.arange(256, dtype=np.uint32))
    assert len(levels) == 1 and len(levels[0][0]) == 256
    assert len(encode(np.array([], np.uint32))) == 1


def brute(rows):
    tok = _tokenizer(default_vocabulary())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for doc_id, text in ordered:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_documents_against_a_plain_loop(spark):
    long = "a very long text with ünïcode and <|endoftext|> inside " * 4000
    rows = [(3, "hello world"), (1, None), (2, ""), (None, "no id"), (3, "hello world"), (4, long), (0, "tie"), (0, "a tie")]
    df = docs(spark, rows, "start", "n_tokens", "ids_crc32", "code", "shard", "place", "no_id")
    got = token_codes(df, Codes(shard_chars=1000)).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert token_codes(docs(spark, [(1, "x")]).where("false")).count() == 0


@pytest.mark.parametrize("cut_bytes, most", [(1, 10**6), (60, 30), (4 << 20, 10**6)])
def test_pieces_encode_like_whole_texts(monkeypatch, cut_bytes, most):
    """Contractions, white space of all kinds, and letters that only the library's tables know."""
    monkeypatch.setattr(module, "_CUT_BYTES", cut_bytes)
    rng = random.Random(cut_bytes)
    bits = [*"aZsStmdrelv  ''\n\t\x85\x1c\x00é\u01319٣!’中😀\u3000\ua7ce\u088f", "'s", "'ll", " '", "'re", " the ", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    tokenizer = _tokenizer(default_vocabulary())
    memo = Memo(tokenizer)
    for at in range(0, 600, 50):
        part = pa.array(["before", *texts[at : at + 50]], pa.large_string()).slice(1)
        ids, amounts = memo.encode(part, 2, most)
        got = [x.tolist() for x in np.split(ids, np.cumsum(amounts)[:-1])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts[at : at + 50]]


def test_ranges_draw_no_text_to_the_driver(spark, tmp_path):
    """Only a doc_id with more text than a shard holds is ranged by its texts; then it is split."""
    rows = [(7, f"{i % 5} some text {i}") for i in range(400)] + [(None, "same text")] * 300 + [(i, "x") for i in range(30)]
    rows = [(d, t) for d, t in random.Random(1).sample(rows, len(rows))]
    path = str(tmp_path / "codes")
    got = token_codes(docs(spark, rows), Codes(shard_chars=1500), path).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str) == brute(rows)
    assert max(r.n_docs for r in spark.read.parquet(path).collect()) < 300
