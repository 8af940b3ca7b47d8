import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattigraph.llm import ordering, packing, sharding, tokens
from lattigraph.llm.common import Feistel
from lattigraph.llm.tokens import ChunkEncoder

from .cases import awkward, frame

ENCODER = ChunkEncoder("word_bpe_49k.json")
TRICKY = ["", "It's   a\ttest's x² ½ ªº ÀÉ'S don'T İ ß Σας ΟΔΟΣ á ﬁ <|endoftext|>hi \x1c b\x07 12,5 __foo_ é́ ǅ ŉ ... '''s ''ll 'LL", "Æ'ré Ñ²³", "ab\r\ncd\x0bef", "THE!! END### a,b;c", "x" * 500]


def whole(texts):
    return [e.ids for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_chunks_encode_like_whole_texts():
    assert [np.frombuffer(b, "<u2").tolist() for b in ENCODER.encode(TRICKY)] == whole(TRICKY)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_alike(t):
    assert np.frombuffer(ENCODER.encode([t])[0], "<u2").tolist() == whole([t])[0]


def test_a_small_cache_changes_nothing():
    e = ChunkEncoder("word_bpe_49k.json", most=2)
    assert e.encode(TRICKY * 2) == ENCODER.encode(TRICKY * 2)
    with pytest.raises(ValueError):
        ChunkEncoder("word_bpe_49k.json", dtype="<u1")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.text(max_size=5))
def test_feistel_is_a_permutation(n, key):
    f = Feistel(n, key)
    p = f.forward(np.arange(n))
    assert sorted(p.tolist()) == list(range(n)) and (f.inverse(p) == np.arange(n)).all()


def test_feistel_depends_on_its_key():
    a, b = (Feistel(10_000, k).forward(np.arange(10_000)) for k in "ab")
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(a, np.arange(10_000))[0, 1]) < 0.05


def documents(rows):
    return sorted(zlib.crc32(np.array(ids + [2], "<u4").tobytes()) for ids in whole([t or "" for _, t in rows]))


def check_pieces(pieces, length):
    """Sequences have no gaps and documents come whole."""
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
    for s, ps in seqs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length if s < max(seqs) else at <= length
    assert sorted(seqs) == list(range(len(seqs)))
    return seqs


@pytest.mark.parametrize("length", [8, 4096])
def test_packing(spark, length):
    rows = awkward()
    df = frame(spark, rows)
    pieces = packing.pack(df, length, with_ids=True).collect()
    seqs = check_pieces(pieces, length)
    streams = [np.frombuffer(b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.offset)), "<u2") for _, ps in sorted(seqs.items())]
    stream = np.concatenate(streams)
    ends = np.flatnonzero(stream == 2)
    docs = [zlib.crc32(d.astype("<u4").tobytes()) for d in np.split(stream, ends + 1) if len(d)]
    assert sorted(docs) == documents(rows)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.frombuffer(bytes(p.ids), "<u2").astype("<u4").tobytes()) and 0 <= p.start < p.doc_tokens
    assert sum(p.length for p in pieces if p.doc_id == 6) == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 6)
    assert packing.pack(frame(spark, []), length).count() == 0


def test_sequences_are_padded(spark):
    out = packing.sequences(packing.pack(frame(spark, awkward()[:9]), 512, with_ids=True), 512).collect()
    for r in out:
        assert len(r.ids) == 2 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 512) and r.boundaries[0] == 0


def test_training_order(spark, tmp_path):
    frame(spark, awkward()).write.parquet(f"file://{tmp_path}/docs")
    df = spark.read.parquet(f"file://{tmp_path}/docs")
    want = {}
    table = packing.tokenize(df)
    for p in packing.cut(table, 256, with_ids=True).orderBy("sequence_id", "offset").collect():
        want[p.sequence_id] = want.get(p.sequence_id, b"") + bytes(p.ids)
    shards = ordering.materialise(df, per_shard=5, length=256)
    got = shards.read().orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(want)))
    order = Feistel(len(want), ordering.KEY)
    assert sorted(r.sequence_id for r in got) == sorted(want)
    assert all(order.forward([r.sequence_id])[0] == r.slot for r in got)
    assert all(bytes(r.ids) == want[r.sequence_id] for r in got), "every record holds its sequence"
    few = ordering.materialise(df, per_shard=5, length=256, task_bytes=1)
    assert [tuple(r) for r in few.read().orderBy("slot").collect()] == [tuple(r) for r in got], "files do not depend on tasks"
    path, at = shards.locate(7)
    with open(path.removeprefix("file://"), "rb") as f:
        f.seek(at)
        assert f.read(len(got[7].ids)) == bytes(got[7].ids)
    assert [bytes(r.ids) for r in shards.read(7).orderBy("slot").collect()] == [bytes(r.ids) for r in got[7:]]
    sizes = {r.shard: (r.records, r.bytes) for r in shards.manifest.collect()}
    assert all(b == n * 512 for n, b in sizes.values()) and sum(n for n, _ in sizes.values()) == len(want)
    assert ordering.materialise(frame(spark, [])).read().count() == 0


def test_sharding(spark):
    rows = awkward() * 3
    got = sharding.shard(frame(spark, rows), 5).collect()
    again = sharding.shard(frame(spark, rows, 7), 5).collect()
    place = lambda out: sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard, r.slot) for r in out)
    assert place(got) == place(again), "the split of the input does not matter"
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    sizes = [len(counts.get(i, [])) for i in range(5)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == want
    order = Feistel(len(rows), sharding.KEY)
    ranked = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    by_hand = sorted((*ranked[n], int(p) % 5, int(p) // 5) for n, p in enumerate(order.forward(np.arange(len(rows)))))
    assert by_hand == sorted(((r.doc_id is not None, r.doc_id or 0), r.text_crc32, r.size, r.shard, r.slot) for r in got), "the place is the permuted number"
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name, dtype", [("byte_bpe_50k.json", "<u2"), ("word_bpe_49k.json", "<u4")])
def test_other_vocabularies_are_encoded_as_their_tokenizer_does(name, dtype):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary_path(name))
    texts = ["Hello world, this is\na test  of ids", " lead", "tail \n\n", None, "", "a\t\u00a0b  c", *(t for _, t in awkward()[:9])]
    got = tokens.ChunkEncoder(name, dtype).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, dtype).tolist() == whole.encode(text or "", add_special_tokens=False).ids
