"""Sinks: delimited text, JSON, lines, text tables. Files are written by the executors, a folder per call."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import CSVConfig

_NESTED = (T.ArrayType, T.StructType, T.MapType)


def csv_fields(df: DataFrame, config: CSVConfig = CSVConfig()) -> list[str]:
    """The configured fields, or all scalar ones without a leading underscore, sorted."""
    if config.fields is not None:
        return list(config.fields)
    return sorted(f.name for f in df.schema.fields if not f.name.startswith("_") and not isinstance(f.dataType, _NESTED))


def _csv_frame(df: DataFrame, config: CSVConfig) -> DataFrame:
    cols = []
    for n in csv_fields(df, config):
        if n not in df.columns:
            cols.append(F.lit("").alias(n))
        elif isinstance(df.schema[n].dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f"`{n}`").cast("array<string>"), ",").alias(n))
        elif isinstance(df.schema[n].dataType, _NESTED):
            cols.append(F.to_json(F.col(f"`{n}`")).alias(n))
        else:
            cols.append(F.col(f"`{n}`"))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, config: CSVConfig = CSVConfig(), one_file: bool = False, mode: str = "overwrite") -> None:
    out = _csv_frame(df, config)
    (out.coalesce(1) if one_file else out).write.mode(mode).option("header", config.header).option("sep", config.delimiter).option("emptyValue", "").csv(path)


def csv_lines(df: DataFrame, config: CSVConfig = CSVConfig()) -> Iterator[str]:
    """Delimited lines one by one, for a Python writer (standard output)."""
    out = _csv_frame(df, config)
    if config.header:
        yield config.delimiter.join(out.columns)
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in out.columns]), {"sep": config.delimiter})
    for r in out.select(line.alias("l")).toLocalIterator():
        yield r.l


def _json_frame(df: DataFrame, json_fields: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({n: F.try_parse_json(F.col(f"`{n}`")) for n in json_fields}) if json_fields else df


def write_json(df: DataFrame, path: str, json_fields: Sequence[str] = (), one_file: bool = False, mode: str = "overwrite") -> None:
    """One object per line; ``json_fields`` hold JSON text and are written as what it stands for."""
    out = _json_frame(df, json_fields).select(F.to_json(F.struct("*")).alias("value"))
    (out.coalesce(1) if one_file else out).write.mode(mode).text(path)


def json_lines(df: DataFrame, json_fields: Sequence[str] = ()) -> Iterator[str]:
    out = _json_frame(df, json_fields)
    for r in out.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns])).alias("j")).toLocalIterator():
        yield r.j


def json_pretty_lines(df: DataFrame, json_fields: Sequence[str] = ()) -> Iterator[str]:
    """The lines of one indented array, a row at a time."""
    held = None
    yield "["
    for line in json_lines(df, json_fields):
        if held is not None:
            yield held + ","
        *rest, held = ["  " + x for x in json.dumps(json.loads(line), indent=2, ensure_ascii=False).splitlines()]
        yield from rest
    if held is not None:
        yield held
    yield "]"


def write_json_pretty(df: DataFrame, path: str, json_fields: Sequence[str] = ()) -> None:
    """One indented array in a local file, row by row."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in json_pretty_lines(df, json_fields))


def write_lines(df: DataFrame, path: str, field: str = "line", one_file: bool = False, mode: str = "overwrite") -> None:
    """The text field of each row, blank where there is none."""
    c = F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("")) if field in df.columns else F.lit("")
    out = df.select(c.alias("value"))
    (out.coalesce(1) if one_file else out).write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def table_lines(df: DataFrame, max_width: int = 50) -> Iterator[str]:
    """All rows as lines of an aligned text table: fields sorted, cells cut with ``...`` at ``max_width``.

    Widths are an aggregate; rows come a partition at a time.
    """
    names = sorted(c for c in df.columns if not c.startswith("_"))
    if not names:
        return
    kinds = {n: df.schema[n].dataType for n in names}
    text = [F.coalesce(F.to_json(F.col(f"`{n}`")) if isinstance(kinds[n], _NESTED) else F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
    cells = [F.when(F.length(c) <= max_width, c).otherwise(F.concat(F.substring(c, 1, max(0, max_width - 3)), F.lit("..."))) for c in text]
    made = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    head = [n if len(n) <= max_width else n[: max(0, max_width - 3)] + "..." for n in names]
    widest = made.agg(*[F.max(F.length(f"c{i}")) for i in range(len(names))]).head()
    wide = [max(len(h), w or 0) for h, w in zip(head, widest, strict=True)]
    first = "   ".join(c.ljust(w) for c, w in zip(head, wide, strict=True)).rstrip()
    yield first
    yield "-" * max(1, len(first))
    for r in made.toLocalIterator(prefetchPartitions=True):
        yield "   ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip()


def format_table(df: DataFrame, max_width: int = 50) -> str:
    """The table as one text, for frames that fit the driver."""
    return "\n".join(table_lines(df, max_width))


def display_table(df: DataFrame, max_width: int = 50) -> None:
    for line in table_lines(df, max_width):
        print(line)
