import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_helpers import frame, odd_texts, prose
from tarnflow.llm import packing, token_file, tokens
from tarnflow.llm.common import new_path, vocabulary

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name, texts):
    t = Tokenizer.from_file(vocabulary(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = random.Random(5)
    texts = [t or "" for t in odd_texts()] + ["it's 'S\n\nx \n y", "a \u00a0b", "ΣΑΣ Σ", "\x01 x", "a\tb c"]
    texts += ["".join(rng.choice(" \n\tab1'sé!Σ\u00a0.,") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    enc = tokens.Encoder(vocabulary(name))
    assert enc.kind in ("led", "words")
    for _ in range(2):  # the second time from the table
        ids, counts = enc.encode(texts)
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == plain(name, texts)


def test_tables_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 50)
    enc = tokens.Encoder(vocabulary(FILES[0]))
    for s in range(5):
        texts = [prose(s * 10 + i, 30) for i in range(10)]
        ids, counts = enc.encode(texts)
        assert np.concatenate(plain(FILES[0], texts)).tolist() == ids.tolist()


def test_other_tokenizers_are_used_whole():
    assert tokens._kind({"model": {"type": "Unigram"}}) == "whole"
    assert tokens._kind({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "Whitespace"}}) == "whole"
    enc = tokens.Encoder(vocabulary(FILES[0]))
    enc.kind = "whole"
    assert enc.encode(["a b", ""])[1].tolist() == [2, 0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=300), st.sampled_from(["bit", "byte"]), st.sampled_from([1, 7, 64, 1000]))
def test_planes_round_trip(ids, plane, block):
    x = np.array(ids, np.uint32)
    data, sizes, width = token_file.encode_planes(x, plane, block)
    assert sum(sizes) == len(data)
    assert (token_file.decode_planes(data, sizes, width, len(x), plane, block) == x).all()


@pytest.mark.parametrize("plane", ["bit", "byte"])
def test_files_round_trip(spark, odd, plane, monkeypatch):
    monkeypatch.setattr(token_file, "CHUNK", 50)
    path = new_path(spark, "test")
    token_file.write(odd, path, vocabulary(FILES[0]), end_id=0, plane=plane, block=64)
    rows = sorted(token_file.read(spark, path).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, ids in zip(rows, plain(FILES[0], odd_texts()), strict=True):
        ids = [*ids, 0]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    with pytest.raises(ValueError):
        token_file.write(odd, path, vocabulary(FILES[0]), plane="nibble")


def test_files_of_odd_tables(spark, repeated, nothing):
    path = new_path(spark, "test")
    token_file.write(nothing, path, vocabulary(FILES[0]))
    assert token_file.read(spark, path).count() == 0
    path = new_path(spark, "test")
    token_file.write(repeated, path, vocabulary(FILES[0]))
    rows = sorted(token_file.read(spark, path, with_ids=False).collect(), key=lambda r: r.start)
    assert len(rows) == len(odd_texts()) + 5
    keys = [r.doc_id if r.doc_id is not None else 1 << 60 for r in rows]
    assert keys == sorted(keys)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows][:-1]]).tolist()


def check_pieces(rows, texts, name, end_id, limits):
    want = [[*ids, end_id] for ids in plain(name, texts)]
    cover = {i: [] for i in range(len(texts))}
    seqs = {}
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and 0 < r.length <= limits.tokens
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        cover[r.doc_id].append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in cover.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(want[i])
    padding = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limits.tokens and len(parts) <= limits.segments
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


@pytest.mark.parametrize("window", [4 << 20, 500])
def test_documents_are_packed_whole(spark, odd, nothing, monkeypatch, window):
    monkeypatch.setattr(packing, "WINDOW", window)
    limits = packing.Limits(tokens=256, segments=16, loss=256)
    texts = odd_texts()
    rows = packing.pack_documents(odd, vocabulary(FILES[1]), limits=limits).collect()
    check_pieces(rows, texts, FILES[1], 2, limits)
    many = [prose(i, 1 + i % 90) for i in range(300)]
    rows = packing.pack_documents(frame(spark, many), vocabulary(FILES[1]), limits=limits).collect()
    total = sum(r.length for r in rows)
    assert check_pieces(rows, many, FILES[1], 2, limits) <= 0.02 * total
    assert packing.pack_documents(nothing, vocabulary(FILES[1])).count() == 0


def test_repeated_rows_are_packed_each(spark, repeated):
    rows = packing.pack_documents(repeated, vocabulary(FILES[1])).collect()
    assert sum(r.start == 0 for r in rows) == len(odd_texts()) + 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90)), max_size=60), st.booleans())
def test_limits_hold(examples, cut):
    limits = packing.Limits(tokens=64, segments=5, loss=40)
    examples = [(t, min(s, t)) for t, s in examples]
    if not cut:
        examples = [(t, s) for t, s in examples if t <= 64 and s <= 40]
    p = packing.Packer(limits, cut)
    for i, (t, s) in enumerate(examples):
        p.add(i, t, s)
    seqs, cover = {}, {}
    for key, start, n, seq, offset in p.take(all_=True):
        t, s = examples[key]
        loss = max(0, min(start + n, t) - max(start, t - s))
        seqs.setdefault(seq, []).append((offset, n, loss))
        cover.setdefault(key, []).append((start, n))
        assert cut or n == t
    for parts in seqs.values():
        assert len(parts) <= 5 and sum(n for _, n, _ in parts) <= 64 and sum(s for _, _, s in parts) <= 40
        assert sorted(o for o, _, _ in parts) == np.cumsum([0, *[n for _, n, _ in sorted(parts)][:-1]]).tolist()
    for key, (t, _) in enumerate(examples):
        assert sum(n for _, n in cover.get(key, [])) == t


def test_instruction_examples(spark):
    rows = [(f"e{i}", 10 + i % 50, 5 + i % 5) for i in range(200)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "id string, tokens long, loss long")
    out = packing.pack_examples(df, packing.Limits(64, 4, 24)).collect()
    assert sorted(r.key for r in out) == sorted(r[0] for r in rows[:-1])
    with pytest.raises(Exception, match="exceeds the limits"):
        packing.pack_examples(spark.createDataFrame([("x", 100, 0)], "id string, tokens long, loss long"), packing.Limits(64, 4, 24)).collect()
    with pytest.raises(ValueError):
        packing.Packer(packing.Limits(0, 1, 1), True)
