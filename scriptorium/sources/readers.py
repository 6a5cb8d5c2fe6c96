"""Readers with declared schemas. Spark's own sources do the work, so columns are
pruned and filters pushed down; nothing is opened on the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_items(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """Whole-file JSON documents, one row for each entry of their array ``items``."""
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode(items).alias("item")).select("item.*")


def json_map(spark: SparkSession, path: str, column: str, value: str, key: str = "key") -> DataFrame:
    """Whole-file JSON documents, one row for each entry of their object ``column``; value is a struct's DDL."""
    m = spark.read.option("multiLine", True).schema(f"{column} map<string, {value}>").json(path)  # a document is a file
    return m.select(F.explode(column).alias(key, "value")).select(key, "value.*")


def json_lines(spark: SparkSession, path: str, schema: str, *, keep_bad: bool = False) -> DataFrame:
    """JSON lines. Blank lines give nothing; lines that cannot be read are dropped, or
    kept with their text in ``_corrupt_record``."""
    if keep_bad:
        return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines stripped of white space that are not blank."""
    return spark.read.text(path).select(F.regexp_replace("value", "^\\s+|\\s+$", "").alias("line")).where("line <> ''")


def tsv_pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Headerless tab-separated pairs; both sides must be there."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(cells) >= 2).select(F.trim(cells[0]).alias(names[0]), F.trim(cells[1]).alias(names[1]))
    return rows.where((F.col(names[0]) != "") & (F.col(names[1]) != ""))


def csv_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A comma-separated table with a header; quotes inside quoted cells are doubled."""
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder: path, length, modificationTime; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime")


def aligned(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files with a line for each other's line: (line, a column for each name). Lines are
    numbered within their file, so files join by number, whatever their partitions."""
    out = None
    for name, path in paths.items():
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", name))
        out = rows if out is None else out.join(rows, "line")
    return out.where(" AND ".join(f"trim({n}) <> ''" for n in paths))


def parallel(spark: SparkSession, path: str, keys: tuple[str, ...] = ("nko", "en", "fr")) -> DataFrame:
    """A parallel file by its suffix: .jsonl, .json (array), .tsv (header or none), .txt (tab pairs).
    A column is taken for the first key that its lower-case name contains."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        raw = spark.read.json(path)
    elif suffix == "json":
        raw = spark.read.option("multiLine", True).json(path)
    elif suffix == "tsv":
        first = spark.read.text(path).limit(1).collect()
        named = bool(first) and any(k in first[0][0].lower() for k in keys)
        raw = spark.read.csv(path, sep="\t", quote="", header=named)
        if not named:
            raw = raw.toDF(*(keys[: len(raw.columns)] if len(raw.columns) <= len(keys) else [*keys, *raw.columns[len(keys) :]]))
    else:
        return tsv_pairs(spark, path, keys[:2])
    chosen = {}
    for c in raw.columns:
        k = next((k for k in keys if k in c.lower()), None)
        if k and k not in chosen:
            chosen[k] = c
    return raw.select(*(F.col(f"`{c}`").cast("string").alias(k) for k, c in chosen.items()))


def unified(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Sources as one table with their names; missing columns are null."""
    out = None
    for name, df in parts:
        own = df.withColumn("origin", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def filtered(df: DataFrame, equal: dict | None = None, null: tuple = (), not_null: tuple = (), order: str | None = None, limit: int | None = None) -> DataFrame:
    """A table read with plain conditions, all of which reach the scan."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    for c in null:
        df = df.where(F.col(c).isNull())
    for c in not_null:
        df = df.where(F.col(c).isNotNull())
    df = df.orderBy(order) if order else df
    return df.limit(limit) if limit is not None else df


def settings(spark: SparkSession, path: str | None, base: dict, environment: dict[str, str]) -> dict:
    """Nested settings: defaults, over them those of a YAML or JSON file (small, read by
    Spark, so in any store), then ``${NAME:-fallback}`` in texts from the environment's values."""
    found = base
    if path is not None:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).orderBy(F.input_file_name()).collect())
        try:
            import yaml
        except ModuleNotFoundError:
            import json

            own = json.loads(text or "{}")
        else:
            own = yaml.safe_load(text) or {}
        found = options(base, own)

    def value(v):
        if isinstance(v, dict):
            return {k: value(x) for k, x in v.items()}
        if isinstance(v, str):
            return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: environment.get(m[1], m[2] or ""), v)
        return v

    return value(found)


def flat(found: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted name, value) of nested settings, in order of names; lists as JSON."""
    import json

    out = []
    for k, v in sorted(found.items()):
        if isinstance(v, dict):
            out += flat(v, f"{prefix}{k}.")
        else:
            out.append((f"{prefix}{k}", v if isinstance(v, str) else json.dumps(v)))
    return out


def options(base: dict, override: dict) -> dict:
    """Nested settings, override over base."""
    out = dict(base)
    for k, v in override.items():
        out[k] = options(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
