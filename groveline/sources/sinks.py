"""Writing artefacts: tables as CSV or Parquet, documents as JSON, a report, figures' data and, where matplotlib is, figures."""

from __future__ import annotations

import datetime
import json
import platform
from collections.abc import Sequence
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.functions.structures import MissingBackend


def write_table(df: DataFrame, path: str, overwrite: bool = False, order: Sequence[str] = ()) -> None:
    """A folder of CSV parts with header, or of Parquet; refuses to replace what is there unless asked. Arrays and maps become JSON."""
    mode = "overwrite" if overwrite else "errorifexists"
    df = df.orderBy(*order) if order else df
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode(mode).parquet(path)
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_rows(df: DataFrame, path: str, most: int = 1_000_000) -> int:
    """A JSON list of rows, for registries, relations and selections; their sizes are capped by their operators, and by ``most``."""
    rows = [json.loads(r["j"]) for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for {path}; write a table instead")
    write_json(rows, path)
    return len(rows)


def write_json(value: Any, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=isinstance(value, dict)) + "\n")


def errors_table(described: DataFrame, set_id: str) -> DataFrame:
    """The failed rows of a set."""
    kind = F.regexp_extract("descriptor_error", "^([A-Za-z]+Error|[A-Za-z]+):", 1)
    empty = F.lit(None).cast("string")
    return described.where("descriptor_error IS NOT NULL").select("compound_id", empty.alias("input_smiles"), "canonical_smiles", F.lit(set_id).alias("descriptor_set"), kind.alias("error_type"), F.col("descriptor_error").alias("error_message"), empty.alias("traceback"))


def manifest(stage: str, config: dict[str, Any], counts: dict[str, Any], warnings: Sequence[str]) -> dict[str, Any]:
    return {
        "stage": stage, "created_at": datetime.datetime.now(datetime.UTC).isoformat(), "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
        "config": config, "counts": counts, "warning_count": len(warnings),
    }


def report(groups: DataFrame, top: int = 30) -> str:
    """Markdown on the best groups: what they are, how they stand out, and a caution."""
    lines = ["# Top groups", ""]
    for r in groups.orderBy("insight_priority_rank", "group_id").limit(top).collect():
        d = r.asDict()
        num = lambda k: "n/a" if d.get(k) is None else f"{d[k]:.4g}"
        lines += [
            f"## {d['insight_priority_rank']}. {d['group_id']}: {d.get('group_label') or 'no label'}", "",
            f"- type and source: {d.get('group_type') or 'unknown'}, {d.get('group_source') or 'unknown'}", f"- size: {d['group_size']}",
            f"- property: median {num('property_median')}, mean {num('property_mean')}, interquartile range {num('property_iqr')}",
            f"- enrichment: high fraction {num('high_active_fraction')}, difference {num('high_active_fraction_delta')}, q-value {num('high_active_fdr_qvalue')}",
            f"- structural diversity: {num('structural_diversity_score')}" if d.get("structural_diversity_available") else "- structural diversity: not available",
            f"- overlaps strongly with better ranked {d['redundant_with_group_id']}" if d.get("redundancy_flag") else "- no strong overlap with a better ranked group",
            f"- note: {_note(d)}", "- caution: a signal for prioritising, not a claim about mechanisms.", "",
        ]
    return "\n".join(lines)


def _note(d: dict[str, Any]) -> str:
    enriched = (d.get("high_active_fdr_qvalue") or 1) < 0.05 and (d.get("high_active_fraction_delta") or 0) > 0
    diverse = (d.get("structural_diversity_score") or 0) > 0.6
    return ("enriched in high values" if enriched else "not clearly enriched") + (" across diverse structures" if diverse else "")


def figure_data(name: str, tables: dict[str, DataFrame], most: int = 20000) -> DataFrame:
    """The rows behind one figure, bounded by a hash-ordered limit where a figure plots single points."""
    pick = {
        "primary_comparison": ("summary", ["representation_id", "primary_comparison_rank", "primary_comparison_rank_score"], False),
        "normalized_sali_distribution": ("edges", ["representation_id", "normalized_sali"], True),
        "sali_ranking": ("summary", ["representation_id", "median_sali", "p90_sali"], False),
        "distance_vs_delta": ("edges", ["representation_id", "distance", "abs_delta_property"], True),
        "local_variance_vs_property": ("local", ["representation_id", "local_mean_property", "local_property_variance"], True),
        "auxiliary_metrics": ("ranking", ["metric_name", "representation_id", "metric_value"], False),
        "enrichment_vs_size": ("groups", ["group_id", "group_size", "high_active_fraction_delta"], True),
        "top_group_distributions": ("members", ["group_id", "property"], True),
        "activity_vs_tanimoto": ("groups", ["group_id", "mean_tanimoto", "property_median"], True),
        "diversity_vs_consistency": ("groups", ["group_id", "structural_diversity_score", "property_iqr"], True),
        "overlap_heatmap": ("overlaps", ["g1", "g2", "jaccard"], True),
        "source_summary": ("sources", ["group_source", "group_count"], False),
        "core_counts": ("cores", ["core", "pair_count", "heavy_atoms", "support"], True),
        "core_pair_counts": ("cores", ["rank", "pair_count"], True),
        "core_heavy_atoms": ("cores", ["heavy_atoms", "pair_count"], True),
        "core_support": ("cores", ["support", "pair_count"], True),
        "core_sweep_groups": ("core_sweep", ["top_n", "min_pair_count", "min_heavy_atoms", "selected_core_count"], False),
        "core_sweep_sizes": ("core_sweep", ["top_n", "min_pair_count", "min_heavy_atoms", "median_group_size", "max_group_size", "singleton_group_count"], False),
        "cluster_sizes": ("clusters", ["parameter_set_id", "cluster_count", "median_size", "max_size"], False),
        "cluster_methods": ("clusters", ["parameter_set_id", "cluster_count", "member_count"], False),
        "cluster_count_sensitivity": ("clusters", ["parameter_set_id", "cluster_count", "singleton_count"], False),
        "cluster_size_sensitivity": ("clusters", ["parameter_set_id", "median_size", "max_size"], False),
    }
    table, columns, points = pick[name]
    df = tables[table].select(*columns)
    return df.orderBy(F.xxhash64(*columns)).limit(most) if points else df


def write_figures(names: Sequence[str], tables: dict[str, DataFrame], folder: str, config: dict[str, Any], overwrite: bool = False) -> list[str]:
    """The rows behind each figure as a table, and its picture where matplotlib is; warnings for pictures that couldn't be drawn."""
    warnings: list[str] = []
    if not config["enabled"]:
        return warnings
    for name in names:
        data = figure_data(name, tables, config.get("max_points_per_plot", config.get("max_groups_per_plot", 20000)))
        write_table(data, f"{folder}/{name}.csv", overwrite)
        try:
            draw(name, data, f"{folder}/{name}.{config['format']}", config["dpi"])
        except MissingBackend as e:
            warnings.append(str(e))
    return warnings


def draw(name: str, data: DataFrame, path: str, dpi: int = 160) -> None:
    """A plain picture of a figure's data; needs matplotlib."""
    try:
        import matplotlib
    except ImportError as e:
        raise MissingBackend(f"figure {name}", "matplotlib") from e
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    rows = data.toPandas()
    fig, ax = plt.subplots()
    numbers = [c for c in rows if rows[c].dtype.kind in "if"]
    if len(numbers) > 1:
        ax.scatter(rows[numbers[0]], rows[numbers[1]], s=6)
        ax.set(xlabel=numbers[0], ylabel=numbers[1])
    elif numbers:
        ax.hist(rows[numbers[0]].dropna(), bins=40)
        ax.set(xlabel=numbers[0])
    fig.savefig(path, dpi=dpi)
    plt.close(fig)
