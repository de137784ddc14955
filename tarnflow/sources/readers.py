"""Readers of delimited text, JSON, lines, command output and Parquet.

Plain readers drop what cannot be read; the ``*_safe`` ones keep such rows with a
message in ``_error``; ``strict=True`` raises. File order is kept as a number per row.
"""

from __future__ import annotations

import csv
import io
import json
import re
import subprocess
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.composing import ERROR

ROW, LINE, RAW, COMMAND = "_row_number", "_line_number", "_raw_line", "_command"


@dataclass(frozen=True)
class CSVConfig:
    header: bool = True
    delimiter: str = ","
    comment: str = "#"
    fields: tuple[str, ...] | None = None


@dataclass(frozen=True)
class CommandConfig:
    header: bool = True
    trim: bool = True
    skip_blank: bool = True


def _in_order(df: DataFrame, name: str, start: int) -> DataFrame:
    """Adds the place of each row in its file, counted from ``start``: an order of parts, then one within each.

    Parts are numbered in file order by ``monotonically_increasing_id``; what lies
    before a part is a running sum over one row per part, joined to its rows.
    """
    ids = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    within = F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = ids.groupBy(F.col("_part").alias("_of")).agg((F.max(within) + 1).alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ids.join(sizes, ids["_part"] == sizes["_of"])
    return placed.withColumn(name, (within + F.col("_before") + start).cast("long")).drop("_id", "_part", "_of", "_before", "_n")


# delimited text


def infer(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text columns as the narrowest type that holds all their values: whole numbers, numbers, bool, else text (trimmed). Empty text is null in typed columns."""
    trimmed = {n: F.trim(F.col(f"`{n}`")) for n in names}
    tests = []
    for i, n in enumerate(names):
        v = F.when(trimmed[n] != "", trimmed[n])
        tests += [
            F.sum(F.when(v.rlike(r"^[+-]?\d+$") & v.try_cast("long").isNotNull(), 1).otherwise(0)).alias(f"l{i}"),
            F.sum(F.when(v.try_cast("double").isNotNull() & v.rlike(r"^[+-]?(\d|\.\d|[iI]nf|NaN)"), 1).otherwise(0)).alias(f"d{i}"),
            F.sum(F.when(v.isin("true", "false"), 1).otherwise(0)).alias(f"b{i}"),
            F.count(v).alias(f"n{i}"),
        ]
    if not names:
        return df
    seen = df.agg(*tests).head()
    made = {}
    for i, n in enumerate(names):
        total = seen[f"n{i}"]
        kind = next((k for k, c in (("long", "l"), ("double", "d"), ("boolean", "b")) if total and seen[f"{c}{i}"] == total), None)
        made[n] = F.when(trimmed[n] != "", trimmed[n]).try_cast(kind) if kind else trimmed[n]
    return df.withColumns(made)


def infer_value(text: str):
    """The value of one cell by itself: whole number, number, bool, else trimmed text."""
    s = text.strip()
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s == "true" if s in ("true", "false") else s


def _header(spark: SparkSession, path: str, config: CSVConfig) -> list[str]:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if config.comment:
        lines = lines.filter(~F.col("value").startswith(config.comment))
    first = lines.head()
    if first is None:
        return []
    cells = next(csv.reader([first.value], delimiter=config.delimiter))
    return [c.strip() for c in cells] if config.header else [f"col_{i}" for i in range(len(cells))]


def read_csv_safe(spark: SparkSession, path: str, config: CSVConfig = CSVConfig()) -> DataFrame:
    """All rows with ``_row_number`` and ``_error``: ragged and malformed ones keep their number and message, with null fields."""
    names = _header(spark, path, config)
    if not names:
        return spark.createDataFrame([], f"{ROW} long, {ERROR} string")
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(schema).option("sep", config.delimiter).option("header", config.header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    reader = reader.option("enforceSchema", True).option("columnPruning", False)
    if config.comment:
        reader = reader.option("comment", config.comment)
    raw = reader.csv(path)
    first = F.col("_c0")  # named beside the bad line, as Spark refuses plans that read nothing but that
    line = F.coalesce(F.col("_bad"), F.nullif(first, first))
    bad = F.when(line.isNotNull(), F.concat(F.lit("wrong number of fields: "), F.substring(line, 1, 80)))
    raw = _in_order(raw.withColumn(ERROR, bad), ROW, 1).drop("_bad")
    good = raw.select(*[F.when(F.col(ERROR).isNull(), F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)], ROW, ERROR)
    return infer(good.fillna("", names), names).withColumns({n: F.when(F.col(ERROR).isNull(), F.col(f"`{n}`")) for n in names})


def read_csv(spark: SparkSession, path: str, config: CSVConfig = CSVConfig(), strict: bool = False) -> DataFrame:
    """Good rows with ``_row_number``; ``strict`` raises at a bad one."""
    from ..operators.composing import ignore_errors, unsafe

    rows = read_csv_safe(spark, path, config)
    return unsafe(rows) if strict else ignore_errors(rows)


def csv_rows(spark: SparkSession, text: io.TextIOBase, config: CSVConfig = CSVConfig()) -> DataFrame:
    """Delimited text that a Python reader holds (standard input); for inputs that fit the driver."""
    rows = [r for r in csv.reader((x for x in text if not (config.comment and x.startswith(config.comment))), delimiter=config.delimiter) if r]
    if not rows:
        return spark.createDataFrame([], f"{ROW} long")
    names = [c.strip() for c in rows.pop(0)] if config.header else [f"col_{i}" for i in range(len(rows[0]))]
    good = [(*r, i) for i, r in enumerate(rows, 1) if len(r) == len(names)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(ROW, T.LongType())])
    return infer(spark.createDataFrame(good, schema), names)


# JSON


def read_json_safe(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; all non-blank lines with ``_line_number`` (from 0, every line counts) and ``_error``."""
    lines = _in_order(spark.read.text(path), LINE, 0)
    lines = lines.filter(F.trim("value") != "")
    parsed = lines.withColumn("_ok", F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"))
    fields = _json_schema(parsed.filter("_ok"))
    record = F.from_json("value", fields) if fields.fields else F.lit(None)
    out = parsed.withColumn("_r", F.when(F.col("_ok"), record))
    return out.select(*[F.col(f"_r.`{f.name}`").alias(f.name) for f in fields.fields], LINE, F.when(~F.col("_ok"), F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))).alias(ERROR))


def _json_schema(objects: DataFrame) -> T.StructType:
    """The type of all JSON objects in the text column ``value``, whatever their fields are called."""
    found = objects.agg(F.schema_of_variant_agg(F.parse_json("value")).alias("s")).head().s
    if not found or not found.startswith("OBJECT"):
        return T.StructType([])
    kind, rest = _variant_type(found)
    return kind if isinstance(kind, T.StructType) and not rest else T.StructType([])


def _variant_type(text: str) -> tuple[T.DataType, str]:
    """The type at the start of a variant's schema, and the text behind it."""
    if text.startswith("ARRAY<"):
        inner, rest = _variant_type(text[6:])
        return T.ArrayType(inner), rest.removeprefix(">")
    if text.startswith("OBJECT<"):
        rest, fields = text[7:], []
        while not rest.startswith(">"):
            rest = rest.removeprefix(", ")
            if rest.startswith("`"):
                m = re.match(r"`((?:[^`]|``)*)`: ", rest)
                name = m[1].replace("``", "`")
            else:
                m = re.match(r"(.*?): ", rest, re.S)
                name = m[1]
            kind, rest = _variant_type(rest[m.end() :])
            fields.append(T.StructField(name, kind))
        return T.StructType(fields), rest[1:]
    m = re.match(r"(\w+)(?:\((\d+),\s*(\d+)\))?", text)
    if m[1] == "DECIMAL":
        kind: T.DataType = T.LongType() if m[3] == "0" and int(m[2]) <= 18 else T.DoubleType()
    else:
        kind = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType()}.get(m[1], T.StringType())
    return kind, text[m.end() :]


def read_json(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Good objects, one per line, with ``_line_number``."""
    from ..operators.composing import ignore_errors, unsafe

    rows = read_json_safe(spark, path)
    return unsafe(rows) if strict else ignore_errors(rows)


def read_json_auto(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects or an object per line, by the first character."""
    first = spark.read.text(path).filter(F.trim("value") != "").head()
    if first is not None and first.value.lstrip().startswith("["):
        return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return read_json(spark, path)


def json_rows(spark: SparkSession, text: io.TextIOBase) -> DataFrame:
    """Objects that a Python reader holds, an array or one per line; bad lines are skipped."""
    whole = text.read()
    objects = []
    if whole.lstrip().startswith("["):
        objects = [x for x in json.loads(whole) if isinstance(x, dict)]
    else:
        for line in whole.splitlines():
            try:
                x = json.loads(line)
            except ValueError:
                continue
            if isinstance(x, dict):
                objects.append(x)
    if not objects:
        return spark.createDataFrame([], T.StructType([]))
    lines = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(objects)], f"{LINE} long, value string")
    fields = _json_schema(lines)
    return lines.withColumn("_r", F.from_json("value", fields)).select(*[F.col(f"_r.`{f.name}`").alias(f.name) for f in fields.fields], LINE)


# lines and commands


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, line_number)``, counted from 0."""
    return _in_order(spark.read.text(path).withColumnRenamed("value", "line"), "line_number", 0)


def read_lines_safe(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.composing import safe

    return safe(read_lines(spark, path))


def _columns(lines: DataFrame, header: str | None, config: CommandConfig) -> DataFrame:
    """Lines cut at white space into the header's columns; the last one takes the rest of the line, absent ones are empty."""
    if not config.header or header is None:
        return lines.select(RAW, LINE)
    names = header.split()
    text = F.trim(F.regexp_replace(RAW, r"\s+", " "))
    words = F.split(text, " ")
    cols: list[Column] = []
    for i, n in enumerate(names):
        one = F.coalesce(F.get(words, F.lit(i)), F.lit(""))
        tail = F.array_join(F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))), " ")
        cols.append((one if i < len(names) - 1 else tail).alias(n))
    out = lines.select(*cols, RAW, LINE)
    return infer(out, names)


def _command_lines(lines: DataFrame, config: CommandConfig) -> DataFrame:
    if config.skip_blank:
        lines = lines.filter(F.trim(RAW) != "")
    if not config.header:
        return _columns(lines, None, config)
    first = lines.orderBy(LINE).head()
    if first is None:
        return _columns(lines, None, config)
    return _columns(lines.filter(F.col(LINE) > first[LINE]), first[RAW], config)


def read_command_output(spark: SparkSession, path: str, config: CommandConfig = CommandConfig()) -> DataFrame:
    """A file of columns parted by white space, with ``_line_number`` and ``_raw_line``."""
    return _command_lines(_in_order(spark.read.text(path).withColumnRenamed("value", RAW), LINE, 0), config)


def read_command_output_safe(spark: SparkSession, path: str, config: CommandConfig = CommandConfig()) -> DataFrame:
    """The same with ``_error`` on lines that have fewer columns than the header."""
    rows = read_command_output(spark, path, config)
    names = [c for c in rows.columns if c not in (RAW, LINE)]
    few = F.size(F.split(F.trim(RAW), r"\s+")) < len(names)
    return rows.withColumn(ERROR, F.when(few, F.lit("too few columns")))


def exec_command(spark: SparkSession, command: str, args: Sequence[str] = (), config: CommandConfig = CommandConfig(), check: bool = True) -> DataFrame:
    """Rows of a command's output, run on the driver; adds ``_command``. A failing command raises unless ``check`` is off."""
    done = subprocess.run([command, *args], capture_output=True, text=True, check=check)
    return _executed(spark, command, args, done.stdout, config)


def exec_command_safe(spark: SparkSession, command: str, args: Sequence[str] = (), config: CommandConfig = CommandConfig()) -> DataFrame:
    """The same; a failure to start or an exit status is a row of its own with ``_error``."""
    from ..operators.composing import safe

    try:
        done = subprocess.run([command, *args], capture_output=True, text=True, check=False)
        out, error = done.stdout, f"exit status {done.returncode}: {done.stderr.strip()}" if done.returncode else None
    except OSError as e:
        out, error = "", str(e)
    rows = safe(_executed(spark, command, args, out, config))
    if error:
        failed = spark.createDataFrame([(error, " ".join([command, *args]))], f"{ERROR} string, {COMMAND} string")
        rows = rows.unionByName(failed, allowMissingColumns=True)
    return rows


def _executed(spark: SparkSession, command: str, args: Sequence[str], out: str, config: CommandConfig) -> DataFrame:
    lines = spark.createDataFrame([(x, i) for i, x in enumerate(out.splitlines())], f"{RAW} string, {LINE} long")
    return _command_lines(lines, config).withColumn(COMMAND, F.lit(" ".join([command, *args])))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
