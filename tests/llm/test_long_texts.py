"""Every operator on a text of megabytes between short ones; deduplication has its own such tests."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm_helpers import frame, prose
from tarnflow.llm import language, mixing, packing, token_file, toxicity, url_filter
from tarnflow.llm.common import cut, new_path, vocabulary


@pytest.fixture(scope="module")
def texts():
    long_ = prose(1, 400_000)
    assert len(long_) > 2_500_000
    return [prose(2, 50), long_, "", prose(3, 20), None]


def test_slices_hold_a_bounded_number_of_bytes():
    import pyarrow as pa

    sizes = [10, 5_000_000, 10, 10, 700_000, 700_000, 10]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["x" * n for n in sizes])], names=["i", "t"])
    got = [x.column(0).to_pylist() for x in cut([b])]
    assert got == [[0], [1], [2, 3, 4], [5, 6]]
    assert [x.num_rows for x in cut([b], rows=2, size=1 << 30)] == [2, 2, 2, 1]


def test_mixing(spark, texts):
    rows = {r.id: r for r in mixing.mix(frame(spark, texts)).collect()}
    assert [rows[i]["size"] for i in range(5)] == [len((t or "").split()) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_files_and_packing(spark, texts, name):
    plain = Tokenizer.from_file(vocabulary(name))
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    path = new_path(spark, "test")
    token_file.write(frame(spark, texts), path, vocabulary(name), end_id=0)
    rows = sorted(token_file.read(spark, path, with_ids=False).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]
    pieces = packing.pack_documents(frame(spark, texts), vocabulary(name), end_id=0).collect()
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert len(own) == p.length and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and p.offset + p.length <= 4096
    assert sum(p.length for p in pieces) == sum(map(len, ids))


def test_languages(spark):
    vowels, hard = "aeio uaie oaea ", "ktrz pkst zrtk "
    texts = [vowels * 200_000, hard * 20, vowels * 20, hard * 30, vowels * 9, hard * 9, vowels * 11, hard * 12]
    langs = ["v", "h"] * 4
    rows = language.identify(frame(spark, texts, langs=["v", "h", "v", "h", "v", "h", "v", "h"])).collect()
    assert all(r.lang_pred == ("v" if texts[r.id].startswith(vowels) else "h") for r in rows) and len(langs) == len(rows)


def test_toxicity(spark):
    texts = [prose(i, 40) + (" nastyword" if i % 4 == 0 else "") for i in range(120)] + [prose(900, 400_000), prose(901, 400_000) + " nastyword"]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    rows = {r.id: r.predicted for r in toxicity.judge(frame(spark, texts), labels).collect()}
    assert (rows[120], rows[121]) == (0, 1)


def test_urls(spark):
    path = "/en/" + "a/" * 500_000
    urls = [f"https://x.example.com{path}?q", "https://example.com/" + "é" * 1_000_000, "a" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge(pages, url_filter.rules_frame(spark, url_filter.RULES)).collect()}
    assert (rows[0].host, rows[0].path, rows[0].rule) == ("x.example.com", path, "com/en/")
    assert rows[0].verdict == "block" and rows[1].rule is None and rows[2].host == ""
