"""The stages one after the other, each on its own input, and the registered queries."""

import re

import pytest

import __spark_entry__
from llm_helpers import frame, prose
from tarnflow.llm import queries

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with planted copies, a shared passage, toxic texts and an odd row or two."""
    root = tmp_path_factory.mktemp("sf")
    passage = prose(77, 40)
    texts, toxic = [], []
    for i in range(240):
        words = prose(i, 50 + i % 30).split()
        bad = i % 8 == 0
        if bad:
            words[3:3] = ["nastyword", "vileword", "nastyword"]
        if i % 10 == 3:
            words[20:20] = passage.split()
        texts.append(" ".join(words))
        toxic.append(int(bad))
    texts += [texts[1], texts[2] + " end", texts[5].replace(" ", "  ", 1), None, ""]
    toxic += [0] * 5
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), texts, toxic


def test_stages(spark, small, tmp_path):
    root, texts, toxic = small
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash_dedup", "suffix_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    after = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, root)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = after[name] = spark.read.parquet(str(tmp_path / name))
    clean = {r.doc_id for r in after["toxicity"].collect()}
    assert clean == {i for i, t in enumerate(toxic) if not t}
    single = {r.doc_id for r in after["simhash_dedup"].collect()}
    assert clean - single == {240, 241, 242, 244}  # copies, and the second of the two without words
    stripped = {r.doc_id: r.text for r in after["suffix_dedup"].collect()}
    assert set(stripped) == single
    passage = prose(77, 40)
    assert sum(passage in (t or "") for t in stripped.values()) == 1
    before = {r.doc_id: r.text for r in after["simhash_dedup"].collect()}
    assert all(stripped[i] == t for i, t in before.items() if t is None or passage not in t)
    taken = after["mixing"].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in taken} <= single and all(r["count"] <= 3 for r in taken)
    pieces = after["packing"].collect()
    assert sum(r.start == 0 for r in pieces) == after["mixing"].count()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_run(spark, small):
    root, _, toxic = small
    rows = pipeline.run(spark, root).collect()
    assert rows and not {r.doc_id for r in rows} & {i for i, t in enumerate(toxic) if t}


def test_odd_rows_go_through(spark, tmp_path):
    """Repeated and missing ids, null and empty texts, null sources and columns of clashing names, from stage to stage."""
    texts = [prose(i, 40) for i in range(30)] + [prose(3, 40), prose(4, 40) + " end", None, "", "x", prose(50, 60), prose(51, 60), prose(50, 60)]
    ids = [*range(30), 3, 90, 91, 92, 92, None, None, 7]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, texts, ids=ids)
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.select("doc_id", "text", "label").collect()
        assert {r.label for r in seen[name]} == {"?"}
    assert len(seen["toxicity"]) == len(texts)
    kept = sorted((r.text or "" for r in seen["simhash_dedup"]))
    # copies go, the near copy goes, of the three without five words the null and the empty one are alike
    assert kept == sorted([*(prose(i, 40) for i in range(30)), "", "x", prose(51, 60), prose(50, 60)])
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


COLUMNS = {
    1: "doc_id fingerprint component_id", 2: "doc_id size source_size target taken", 3: "doc_id n_bytes n_removed n_spans kept_sha256", 4: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    5: "doc_id start n_tokens ids_crc32", 6: "doc_id held_out lang_pred score", 7: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 8: "vec_id n_links component_id kept", 9: "page_id host path rule verdict", 10: "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_their_columns(spark, name):
    out = queries.QUERIES[name](spark, SF)
    n = int(re.match(r"op(\d+)_", name)[1])
    assert set(COLUMNS[n].split()) <= set(out.columns)
    table = {8: "embeddings", 9: "pages"}.get(n, "documents")
    rows, key = out.count(), out.columns[0]
    if n != 7:
        assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count() == out.select(key).distinct().count()
