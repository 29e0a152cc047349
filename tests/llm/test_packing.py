import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from candlemill.llm import packing

TEXTS = [
    "", " ", "a  b\tc\r\n d", "It's we'LL don't 's", "Σίσυφος ΟΔΟΣ İstanbul", "é é ﬁ", "日本語 テスト 12.34", "a\xa0b c　d\x85e\x1cf\x1fg",
    "<|endoftext|> <|startoftext|>x", "***... $1,234.5%% a_b-c", "👩‍👩‍👧 ok‍", "́x", "ǅ ʼn ß ẞ", "x\x00y\x0bz", "ªº² Ⅷ ⅷ ٣", "word " * 9000, None, "word " * 9000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary())


@pytest.mark.parametrize("as_text", [False, True])
def test_word_encoder_gives_the_tokenizers_ids(as_text):
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    tokenizer.encode_special_tokens = as_text
    e = packing.WordEncoder(packing.vocabulary(), as_text)
    for text in [*TEXTS, "a<|endoftext|> b", "Σ<|startoftext|>x", "ΑΣ ΣΑ aΣ", "<|ENDOFTEXT|>"]:
        assert np.frombuffer(e.encode(text or ""), "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_fill_sequences_without_gap(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, piece string")
    rows = packing.pack_documents(docs).collect()
    want = {}
    for i, t in enumerate(TEXTS):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_other_vocabularies_go_through_the_tokenizer():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = packing.WordEncoder(path), Tokenizer.from_file(path)
    for text in TEXTS:
        assert np.frombuffer(e.encode(text or ""), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_repeated_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(None, "same words", 1)] * 400, "doc_id long, text string, offset int")
    rows = packing.table(packing.pieces(docs, capacity=64), "pieces")
    got = packing.best_fit(rows, 64, shard_tokens=300).collect()
    per = defaultdict(int)
    for r in got:
        per[r.sequence_id] += r.length
    assert len(got) == 400 and max(per.values()) <= 64
    shards = -(-sum(per.values()) // 300)
    assert len({k % shards for k in per}) == shards


def test_pack_is_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 4096, 3000)
    where, offset = packing.pack(lengths)
    fill = np.bincount(where, lengths)
    assert fill.max() <= 4096 and len(fill) <= 1.03 * max(lengths.sum() / 4096, (lengths > 2048).sum())
    large = np.bincount(where, 3 * lengths > 4096)
    assert large.max() <= 2


def test_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_worker_forgets_after_a_task():
    """What stays in a worker between tasks is the model, not the words of the last one; ids are the same afterwards."""
    from candlemill.llm import packing

    e = packing.WordEncoder(packing.vocabulary())
    first = e.encode("some words and others")
    assert e._words and e._parts
    e.forget()
    assert not e._words and not e._parts and e.encode("some words and others") == first
