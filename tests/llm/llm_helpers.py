"""Odd documents and what tests of several operators need."""

from pyspark.sql import types as T

#: Columns whose names operators use inside.
CLASHING = ["id", "fp", "component", "h", "r", "size", "copies", "node", "label", "doc", "spans", "_rid", "_copies", "v", "rep", "k", "u", "s", "shard"]

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """``n`` pseudo-random words."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % 20] + WORDS[(x >> 13) % 20][: 1 + (x >> 20) % 3])
    return " ".join(out)


def odd_texts() -> list[str | None]:
    base = prose(1, 60)
    words = base.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    return [base, base, near, base.upper(), None, "", " ", "\n\t", "one", "one two", "one two three", "x" * 3000, "é" * 200, "日本語 テキスト " * 40, prose(2, 400), prose(2, 400)[:900] + prose(3, 100), "a  b   c", "<|endoftext|> b\x00c", base + " " + base, "!" * 250]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None, sources=None, langs=None, clash=True):
    """A documents table, with columns of clashing names behind it."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or [None if i % 5 == 4 else f"s{i % 3}" for i in range(len(texts))]
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, s, len(t or "")) for i, t, g, s in zip(ids, texts, langs, sources, strict=True)]
    extra = CLASHING if clash else []
    schema = T._parse_datatype_string(SCHEMA)
    for c in extra:
        schema = schema.add(c, T.StringType())
    return spark.createDataFrame([(*r, *["?"] * len(extra)) for r in rows], schema).repartition(3, "doc_id")


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
