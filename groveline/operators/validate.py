"""Roles, profiles and strict checks of input tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names by which roles are found.
ID_NAMES = "compound_id compoundid molecule_id moleculeid mol_id molid cid id name compound molecule code".split()
STRUCTURE_NAMES = "smiles canonical_smiles isomeric_smiles structure mol_smiles molecule_smiles".split()
GROUP_NAMES = "group grouping series subseries scaffold chemotype core core_id cluster class family human_series human_scaffold project_group campaign".split()
FILE_ID_NAMES = "compound_id Compound_ID ID id mol_id molecule_id".split()
NOT_FEATURES = "compound_id canonical_smiles input_smiles original_smiles mol_parse_ok descriptor_error mol_error source_row_index row_index exclusion_reason".split()
VIRTUAL = {"true": True, "1": True, "yes": True, "virtual": True, "predicted": True, "false": False, "0": False, "no": False, "wet": False, "measured": False, "experimental": False}


class InputError(ValueError):
    """The input can't be used; nothing has been written."""


class AmbiguousColumn(InputError):
    """Several columns fit one role equally well: the caller has to name one."""

    def __init__(self, role: str, columns: Sequence[str]):
        super().__init__(f"several columns may be the {role}: {', '.join(columns)}")
        self.role, self.columns = role, list(columns)


def normalised(name: str) -> str:
    """Header without case, spaces, hyphens and underscores."""
    return re.sub(r"[\s_\-]+", "", name).lower()


def named(columns: Iterable[str], candidates: Sequence[str]) -> list[str]:
    """The columns whose header matches a candidate, best candidate first."""
    order = {normalised(c): i for i, c in reversed(list(enumerate(candidates)))}
    return sorted((c for c in columns if normalised(c) in order), key=lambda c: order[normalised(c)])


def number(c: Column) -> Column:
    """Tolerant cast: what isn't a finite or infinite number is null, NaN too."""
    v = c.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def profile(df: DataFrame) -> DataFrame:
    """column_name, row_count, missing_count, distinct_count, numeric_count, avg_length: one row for each column, in one pass."""
    parts = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        text = v.cast("string")
        parts += [
            F.count_if(blank(v)).alias(f"m{i}"), F.count_distinct(F.when(~blank(v), text)).alias(f"d{i}"),
            F.count_if(~blank(v) & number(v).isNotNull()).alias(f"n{i}"), F.avg(F.when(~blank(v), F.length(text))).alias(f"l{i}"),
        ]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("row_count"), F.col(f"m{i}").alias("missing_count"), F.col(f"d{i}").alias("distinct_count"), F.col(f"n{i}").alias("numeric_count"), F.col(f"l{i}").alias("avg_length")) for i, c in enumerate(df.columns)])
    return one.select(F.inline(rows))


def id_candidates(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Columns ranked as ids: few blanks, few repeats, a good name, not only numbers."""
    known = {c: len(ID_NAMES) - i for i, c in enumerate(named(df.columns, ID_NAMES))}
    score = F.lit(0)
    for c, s in known.items():
        score = F.when(F.col("column_name") == c, F.lit(s)).otherwise(score)
    p = profile(df).where(~F.col("column_name").isin(list(exclude) or [""]))
    filled = F.greatest(F.col("row_count") - F.col("missing_count"), F.lit(1))
    p = p.withColumn("missing_rate", F.col("missing_count") / F.greatest("row_count", F.lit(1))).withColumn("distinct_ratio", F.col("distinct_count") / filled)
    p = p.withColumn("name_score", score).withColumn("only_numbers", F.col("numeric_count") == filled)
    total = 3 * (1 - F.col("missing_rate")) + 3 * F.col("distinct_ratio") + F.col("name_score") / len(ID_NAMES) * 3 - F.col("only_numbers").cast("int")
    return p.where("distinct_ratio > 0.95 AND missing_rate < 0.05").withColumn("id_score", total).orderBy(F.desc("id_score"), "column_name")


def choose_id(df: DataFrame, given: str | None = None, exclude: Sequence[str] = ()) -> tuple[str, list[str]]:
    """(column, warnings). A tie at the top is ambiguous; a column of numbers only is taken with a warning."""
    if given:
        if given not in df.columns:
            raise InputError(f"no column {given}")
        return given, []
    best = id_candidates(df, exclude).limit(2).collect()
    if not best:
        raise InputError("no column can be the id")
    if len(best) == 2 and best[0]["id_score"] == best[1]["id_score"]:
        raise AmbiguousColumn("id", [r["column_name"] for r in best])
    return best[0]["column_name"], ["the id column holds numbers only"] if best[0]["only_numbers"] else []


def file_id(columns: Sequence[str]) -> str:
    """The id column of a representation file."""
    found = [c for n in FILE_ID_NAMES for c in columns if c == n]
    if not found:
        raise InputError("no id column in a representation file")
    return found[0]


def choose_property(columns: Sequence[str], given: str | None, preferred: Sequence[str], strict: bool) -> str:
    """strict: several preferred names at once are an error; else the first of them."""
    if given:
        if given not in columns:
            raise InputError(f"no column {given}")
        return given
    found = [p for p in preferred if p in columns]
    if not found:
        raise InputError("no property column")
    if strict and len(found) > 1:
        raise AmbiguousColumn("property", found)
    return found[0]


def structure_tier(ratio: float) -> str:
    """high from 0.85, medium from 0.5, else low: share of values that parse."""
    return "high" if ratio >= 0.85 else "medium" if ratio >= 0.5 else "low"


def group_candidates(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Columns that can group: categorical, 2 to max(50, half the rows) values, few blanks, not near-unique, not excluded."""
    filled = F.col("row_count") - F.col("missing_count")
    fits = F.col("distinct_count").between(F.lit(2), F.greatest(F.lit(50.0), 0.5 * F.col("row_count")))
    few = F.col("missing_count") <= 0.5 * F.col("row_count")
    return profile(df).where(~F.col("column_name").isin(list(exclude) or [""]) & fits & few & (F.col("distinct_count") < 0.9 * filled)).select("column_name", "distinct_count", "missing_count")


def id_problems(df: DataFrame, id_column: str) -> DataFrame:
    """problem (blank or duplicate), id_value, row_count of ids that can't stand."""
    v = F.col(f"`{id_column}`").cast("string")
    found = df.select(F.when(~blank(v), v).alias("id_value")).groupBy("id_value").agg(F.count(F.lit(1)).alias("row_count"))
    return found.where("id_value IS NULL OR row_count > 1").select(F.when(F.col("id_value").isNull(), "blank").otherwise("duplicate").alias("problem"), "id_value", "row_count")


def require_ids(df: DataFrame, id_column: str, examples: int = 5) -> None:
    """Raises if an id is blank or repeated, with some of them."""
    bad = id_problems(df, id_column).orderBy("problem", "id_value").limit(examples).collect()
    if bad:
        raise InputError("; ".join(f"{r['problem']} id {r['id_value'] or ''} in {r['row_count']} rows" for r in bad))


def valid_property(df: DataFrame, column: str) -> DataFrame:
    """df with ``property`` as a number; rows without one are gone."""
    return df.withColumn("property", number(F.col(f"`{column}`"))).where("property IS NOT NULL")


def property_report(df: DataFrame, column: str) -> DataFrame:
    """row_count, missing_count, not_numeric_count, valid_count."""
    v = F.col(f"`{column}`")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(blank(v)).alias("missing_count"), F.count_if(~blank(v) & number(v).isNull()).alias("not_numeric_count"), F.count_if(number(v).isNotNull()).alias("valid_count"))


def feature_columns(df: DataFrame) -> list[str]:
    """Columns outside the fixed exclusions of which some value is a number and every filled value is."""
    names = [c for c in df.columns if c not in NOT_FEATURES and c not in FILE_ID_NAMES]
    if not names:
        return []
    counts = df.agg(*[F.count(number(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(names)], *[F.count_if(~blank(F.col(f"`{c}`"))).alias(f"f{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if counts[f"n{i}"] and counts[f"n{i}"] == counts[f"f{i}"]]


def virtual_flag(c: Column) -> Column:
    """True for a virtual row, from any known spelling; what is unknown or missing is wet."""
    v, out = F.lower(F.trim(c.cast("string"))), F.lit(False)
    yes = [k for k, x in VIRTUAL.items() if x]
    return F.coalesce(F.when(v.isin(yes), F.lit(True)).otherwise(out), out)


@dataclass
class Coverage:
    matched: DataFrame
    extra: DataFrame
    missing: DataFrame


def coverage(features: DataFrame, compounds: DataFrame, key: str) -> Coverage:
    """Inner rows of features, ids that only features have, ids that they lack."""
    ids = compounds.select(key).distinct()
    return Coverage(features.join(ids, key, "left_semi"), features.select(key).join(ids, key, "left_anti"), ids.join(features.select(key), key, "left_anti"))
