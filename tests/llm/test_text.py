import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings, strategies as st

from keylattice.llm import bpe, packing, textkit as tk


def split(text):
    out, word = [], ""
    for c in text.lower():
        if c.isascii() and not c.isalnum():
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=80, deadline=None)
def test_words_and_shingles(texts):
    w = tk.words(pa.array(texts, pa.string()))
    own = [split(t) for t in texts]
    assert w.counts.tolist() == [len(x) for x in own]
    flat = [x for o in own for x in o]
    assert [w.text(i) for i in range(len(w.hashes))] == flat
    by = {}
    for word, h in zip(flat, w.hashes.tolist()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)
    h, first = tk.shingles(w, 2)
    assert len(h) == sum(max(0, len(o) - 1) for o in own)


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab ,.'\n\t 　é中1!")), max_size=30), max_size=5))
@example(["\n\na"]).via("blank line at the start")
@example(["a\n\nb", "a \nb", "a\r\nb", "a\n\n\nb c", "a\n \nb", "a\n", "b", "\nc", "\n\n", "'s\n\n's"]).via("blank lines")
@settings(max_examples=600, deadline=None)
def test_chunked_ids_are_the_encoders_ids(texts):
    encode = bpe.ChunkEncoder()
    for _ in range(2):  # from a cold and a warm cache
        ids, first = encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == encode.encoder.encode_ordinary(t)


@pytest.mark.parametrize("longest", [1, 8, 8192])
def test_decompose(longest):
    lengths = np.array([0, 1, 7, 8, 9, 23, 40_001])
    seq, piece, start, length = packing.decompose(lengths, longest)
    for i, n in enumerate(lengths):
        own = seq == i
        assert length[own].sum() == n
        assert start[own].tolist() == (np.cumsum(length[own]) - length[own]).tolist()
        assert piece[own].tolist() == list(range(own.sum()))
        assert all(x & (x - 1) == 0 and x <= longest for x in length[own].tolist())
        small = [x for x in length[own].tolist() if x < longest]
        assert small == sorted(set(small), reverse=True)
    with pytest.raises(ValueError):
        packing.decompose(lengths, 6)


def test_pack_round_trip(frame, odd):
    encode = bpe.encoding(bpe.DEFAULT_VOCABULARY)
    rows = packing.pack(frame(odd)).collect()
    assert {r["doc_id"] for r in rows} == {1, None, 5, 6, 7, 8}
    for doc in (6, 7, 8):
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [t for r in own for t in r["tokens"]] == encode.encode_ordinary(dict(odd)[doc])
        assert all(len(r["tokens"]) == r["length"] == 2 ** r["bucket"] for r in own)
    assert len([r for r in rows if r["doc_id"] == 1]) % 2 == 0
    assert packing.pack(frame([])).count() == 0


def test_write_buckets(spark, frame, prose, tmp_path):
    p = packing.pack(frame([(1, prose(1, 50))]))
    packing.write_buckets(p, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == p.count() and back.where("length <> pow(2, bucket)").count() == 0
