"""Reading input tables, representation files, membership matrices and registries."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groveline.operators.groups import from_matrix
from groveline.operators.validate import InputError, file_id

MEMBERSHIP = "group_id string, compound_id string, membership_source string, membership_reason string"
RELATIONS = "relation_id string, source_group_id string, target_group_id string, relation_type string, metrics struct<jaccard_overlap: double, shared_compound_count: bigint>"
REGISTRY = "group_id string, group_label string, group_type string, group_source string, source_column string, activity_blind boolean, definition map<string, string>, compound_count bigint, wet_count bigint, virtual_count bigint, quality struct<status: string, exploratory: boolean>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; nothing is inferred. A file that can't be read is an InputError."""
    try:
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except Exception as e:
        raise InputError(f"can't read {path}: {type(e).__name__}") from e


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, or Parquet as its columnar twin."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)


def representation_files(config: dict[str, Any], stem: str) -> list[Path]:
    """The files of base_dir/subdir (the input's stem if null) that match the glob and aren't to be skipped."""
    if not config["enabled"]:
        return []
    folder = Path(config["base_dir"]) / (config["subdir"] or stem)
    return sorted(p for p in folder.glob(config["file_glob"]) if p.name not in config["skip_files"])


def matched(files: Sequence[Path], representations: dict[str, dict[str, Any]]) -> tuple[list[tuple[str, Path, dict[str, Any]]], list[str]]:
    """(representation id, file, its block) by exact name or glob, and warnings for what matches nothing."""
    out, warnings = [], []
    used: set[Path] = set()
    for name, block in representations.items():
        hits = [f for f in files if f.name == block["match"]] or [f for f in files if fnmatch.fnmatch(f.name, block["match"])]
        if not hits:
            warnings.append(f"representation {name}: no file matches {block['match']}")
        for f in hits[:1]:
            out.append((name, f, block))
            used.add(f)
    return out, warnings + [f"file {f.name}: no representation matches" for f in files if f not in used]


def read_representation(spark: SparkSession, path: str) -> DataFrame:
    """A representation file with its id column as compound_id, ids trimmed; and the file's name."""
    df = read_table(spark, path)
    key = file_id(df.columns)
    return df.withColumnRenamed(key, "compound_id").withColumn("compound_id", F.trim(F.col("compound_id").cast("string")))


def read_membership_matrix(spark: SparkSession, path: str) -> DataFrame:
    """group_id, compound_id of the ones of a 0/1 matrix; anything else in a cell is an error."""
    df = read_table(spark, path)
    key = file_id(df.columns)
    return from_matrix(df.withColumnRenamed(key, "compound_id"))


def _optional_json(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    if not path or not Path(path).exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(T._parse_datatype_string(schema)).option("multiLine", True).json(path)


def read_registry(spark: SparkSession, path: str | None, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry of the groups, ids of groups that it lacks): those stay, with nulls."""
    known = _optional_json(spark, path, REGISTRY)
    ids = groups.select("group_id").distinct()
    return ids.join(known, "group_id", "left"), ids.join(known, "group_id", "left_anti")


def read_relations(spark: SparkSession, path: str | None) -> DataFrame:
    return _optional_json(spark, path, RELATIONS)


def read_memberships(spark: SparkSession, path: str | None) -> DataFrame:
    if not path or not Path(path).exists():
        return spark.createDataFrame([], MEMBERSHIP)
    return read_csv(spark, path)
