"""The four runs: describe, group, landscape, insight. Each checks its inputs before it writes anything."""

from __future__ import annotations

import argparse
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline import config as cfg
from groveline.functions import models, stats, structures
from groveline.operators import clustering, features, groups, insight, landscape, neighbours, validate
from groveline.sources import sinks, tables
from groveline.storage import written


def _compounds(spark: SparkSession, path: str, id_column: str | None, virtual: str | None = None) -> tuple[DataFrame, str, list[str]]:
    df = tables.read_table(spark, path)
    key, warnings = validate.choose_id(df, id_column or next(iter(validate.named(df.columns, validate.ID_NAMES)), None))
    validate.require_ids(df, key)
    flag = virtual or next((c for c in df.columns if validate.normalised(c) == "isvirtual"), None)
    if flag is None:
        warnings.append("no flag of virtual compounds; all count as measured")
    df = df.withColumn("is_virtual", validate.virtual_flag(F.col(f"`{flag}`")) if flag else F.lit(False))
    df = df.withColumn("compound_id", F.trim(F.col(f"`{key}`").cast("string")))
    return df, key, warnings


def _vectors(spark: SparkSession, path: Path, among: DataFrame, scaling: str, constants: bool) -> tuple[DataFrame, int, list[str]]:
    raw = tables.read_representation(spark, str(path))
    columns = validate.feature_columns(raw)
    if not columns:
        raise validate.InputError(f"{path.name}: no numeric feature")
    seen = validate.coverage(raw.select("compound_id"), among, "compound_id")
    warnings = [f"{path.name}: {n} {what}" for n, what in ((seen.extra.count(), "ids aren't in the input"), (seen.missing.count(), "input ids are missing")) if n]
    df = features.prepared(features.packed(raw, "compound_id", columns), "compound_id", scaling, constants, among)
    return df, len(columns), warnings


def _structure(df: DataFrame, key: str) -> tuple[str | None, str | None, list[str]]:
    """The structure column by name and by how many of its values can be read."""
    named = validate.named(df.columns, validate.STRUCTURE_NAMES)
    text = [c for c, t in df.dtypes if t == "string" and c not in (*named, key, "compound_id")]
    return structures.structure_column(df, named, text)


def _embedded(mols: DataFrame, s: structures.DescriptorSet, known: dict[str, models.Model], folder: str) -> DataFrame:
    """What ``structures.described`` gives, by a pretrained model. Structures that can't be read have no vector."""
    vectors = models.embedded(mols.where("mol_parse_ok"), known.get(s.set_id), s.set_id, f"{folder}/{s.set_id}")
    out = mols.select("compound_id", "canonical_smiles", "mol_parse_ok").join(vectors, "compound_id", "left")
    error = F.when(~F.col("mol_parse_ok"), "structure can't be read").when(F.col("features").isNull(), "the model gave no vector")
    return out.select("compound_id", "canonical_smiles", "mol_parse_ok", error.alias("descriptor_error"), "features")


def describe(spark: SparkSession, source: str, outdir: str, sets: list[str] | None = None, enable_3d: bool = False, id_column: str | None = None, structure: str | None = None, overwrite: bool = False, dry_run: bool = False, registry: str | None = None, model_dirs: list[str] | None = None) -> dict[str, Any]:
    """One table for each descriptor set; sets fail one by one. A dry run reports what would be done. registry, model_dirs: where pretrained models are."""
    known = models.registry(registry, model_dirs or [])
    df, key, warnings = _compounds(spark, source, id_column)
    tier = None
    if structure is None:
        structure, tier, more = _structure(df, key)
        warnings += more
    if structure is None:
        raise validate.InputError("no structure column")
    chosen = structures.selected_sets(sets, enable_3d)
    plan = {"id_column": key, "structure_column": structure, "structure_tier": tier, "row_count": df.count(), "sets": [s.set_id for s in chosen], "files": [s.output for s in chosen]}
    if dry_run:
        return plan
    mols = written(structures.parsed(df.select("compound_id", F.col(f"`{structure}`").alias("input_smiles")), "input_smiles"))
    errors = None
    failed: dict[str, int] = {}
    for s in chosen:
        try:
            out = written(_embedded(mols, s, known, str(Path(outdir) / "exchange")) if s.requires_model_dir else structures.described(mols, s))
        except structures.MissingBackend as e:
            if not s.requires_model_dir:
                raise
            warnings.append(str(e))
            out = mols.select("compound_id", "canonical_smiles", "mol_parse_ok", F.lit(f"MissingBackend: {e}").alias("descriptor_error"), F.lit(None).cast("array<double>").alias("features"))
        sinks.write_table(out, str(Path(outdir) / s.output), overwrite, ["compound_id"])
        bad = sinks.errors_table(out, s.set_id)
        failed[s.set_id] = bad.count()
        errors = bad if errors is None else errors.unionByName(bad)
    if errors is not None:
        sinks.write_table(errors, str(Path(outdir) / "errors.csv"), overwrite)
    sinks.write_json(sinks.manifest("describe", plan, {"errors": failed}, warnings), str(Path(outdir) / "run_metadata.json"))
    return plan | {"errors": failed}


def _clusters(nodes: DataFrame, vectors: DataFrame, block: dict[str, Any], metric: str, guards: dict[str, int], warnings: list[str]) -> DataFrame | None:
    """parameter_set_id, node, cluster over the configured grid. Guards are asked before anything is computed."""
    methods = []
    for method in block["methods"]:
        try:
            clustering.allowed(nodes, guards.get(method), method)
            methods.append(method)
        except clustering.TooLarge as e:
            warnings.append(str(e))
    grid, out = clustering.grid({**block, "methods": methods}), None
    full = near = None
    if any("threshold" in g for g in grid):
        full = written(neighbours.full_graph(vectors, "compound_id", metric, min(block["thresholds"])))
    if any("top_k" in g for g in grid):
        near = written(neighbours.knn(vectors, "compound_id", metric, max(block["top_k"])))
    for method in methods:
        own = [g for g in grid if g["method"] == method]
        if method == "connected_components":
            parts = [clustering.components(nodes, full.where(F.col("weight") >= g["threshold"])).withColumn("parameter_set_id", F.lit(clustering.parameter_set_id(g))) for g in own]
        elif method == "dbscan":
            parts = [clustering.dbscan(nodes, full.where(F.col("weight") >= g["threshold"]), g["min_samples"]).drop("is_core").withColumn("parameter_set_id", F.lit(clustering.parameter_set_id(g))) for g in own]
        elif method in ("louvain", "leiden"):
            parts = [clustering.swept(nodes, neighbours.top_k_graph(near, k), [g for g in own if g["top_k"] == k], guards.get(method)) for k in block["top_k"]]
        else:
            parts = [clustering.swept(nodes, full, own, guards.get(method))]
        for p in parts:
            p = written(p.select("parameter_set_id", "node", "cluster"))
            out = p if out is None else out.unionByName(p)
    return None if out is None else clustering.large_enough(out, ["parameter_set_id"], block["min_cluster_size"])


def _cores(mols: DataFrame, block: dict[str, Any], warnings: list[str]) -> tuple[DataFrame | None, dict[str, DataFrame]]:
    """(membership of common cores, tables for figures): a bounded sample is mined, measured compounds first, and the cores found are looked up in all structures."""
    sample = written(groups.wet_first_sample(mols, "compound_id", block["max_mcs_sample_compounds"]))
    text = sample.select("compound_id", "canonical_smiles")
    pairs = groups.capped_pairs(sample, "compound_id", block["max_mcs_pair_count"])
    pairs = pairs.join(text.select(F.col("compound_id").alias("id_a"), F.col("canonical_smiles").alias("smiles_a")), "id_a").join(text.select(F.col("compound_id").alias("id_b"), F.col("canonical_smiles").alias("smiles_b")), "id_b")
    mined = written(structures.mined_cores(pairs, block["timeout_seconds_per_pair"]))
    ranked = written(groups.ranked_cores(groups.core_candidates(mined)))
    chosen = groups.selected_cores(ranked, block["candidate_top_n"], block["candidate_min_pair_count"], block["min_mcs_heavy_atoms"], block["selection_mode"]).where("selected")
    names = [r["core"] for r in ranked.select("core").collect()]  # as many as mined pairs at most
    if not names:
        warnings.append("no common core was found")
        return None, {}
    found = written(structures.expanded(names, mols))
    tables = {"cores": ranked, "core_sweep": groups.parameter_sweep(ranked, found, [10, 20, 30, 50, 100], [1, 3, 5, 10, 20, 50], [4, 6, 8, 10, 12, 15], block["selection_mode"])}
    cores = groups.without_nested(chosen, found.join(chosen.select("core"), "core", "left_semi"), block["support_similarity"])
    return groups.core_groups(cores, found), tables


def _structure_groups(mols: DataFrame, config: dict[str, Any], warnings: list[str]) -> tuple[list[DataFrame], dict[str, DataFrame]]:
    """Memberships by scaffold, common core, fragment and fingerprint similarity, and tables for figures."""
    build, parts, tables = config["group_builders"], [], {}
    if build["murcko_group_builder"]["enabled"]:
        parts.append(groups.keyed_groups(structures.scaffolds(mols), "compound_id", "scaffold_smiles", "MURCKO", "murcko"))
    if build["mcs_group_builder"]["enabled"]:
        found, tables = _cores(mols, build["mcs_group_builder"], warnings)
        parts += [] if found is None else [found]
    block = build["brics_recap_fragment_builder"]
    if block["enabled"]:
        every = written(structures.fragments(mols))
        found = groups.fragment_groups(every, block["min_fragment_compound_count"], block["min_fragment_heavy_atoms"], block["max_fragments_per_method"])
        parts.append(groups.fragment_members(found, every))
    block = build["similarity_group_builder"]
    if block["enabled"]:
        bits = written(structures.described(mols, structures.SETS["L02"]).where("features IS NOT NULL").select("compound_id", "features"))
        found = _clusters(bits.select(F.col("compound_id").alias("node")), bits, block, "tanimoto", config["guards"], warnings)
        if found is not None:
            named = found.withColumn("_k", F.concat_ws("/", F.lit("structure"), "parameter_set_id", "cluster")).withColumnRenamed("node", "compound_id")
            parts.append(groups.keyed_groups(named, "compound_id", "_k", "SIM", "similarity", block["min_cluster_size"]))
            tables["clusters"] = clustering.sensitivity(found)
    return parts, tables


def grouping(spark: SparkSession, source: str, outdir: str, config: dict[str, Any] | None = None, id_column: str | None = None, grouping_columns: list[str] | None = None, virtual: str | None = None, overwrite: bool = False) -> dict[str, Any]:
    """Builds, filters and relates groups. Structure builders run only where a backend is."""
    config = cfg.checked(cfg.merged(cfg.GROUPING, config or {}))
    df, key, warnings = _compounds(spark, source, id_column, virtual)
    compounds = written(df.select("compound_id", "is_virtual"))
    build, parts, summaries = config["group_builders"], [], []
    human = build["human_group_builder"]
    if human["enabled"]:
        columns = grouping_columns or human["grouping_columns"] or validate.named(df.columns, validate.GROUP_NAMES)
        if columns:
            parts.append(groups.human_groups(df, "compound_id", columns, human["combine_columns"] or []))
        else:
            warnings.append("no grouping column")
    block = build["descriptor_clustering_builder"]
    for path in tables.representation_files(config["description_inputs"], Path(source).stem) if block["enabled"] else []:
        try:
            v, width, more = _vectors(spark, path, compounds, block["scaling"], True)
            warnings += more
            v = written(v)
            n = v.count()
            if n < block["min_compounds"]:
                raise validate.InputError(f"{path.name}: {n} compounds")
        except validate.InputError as e:  # a bad file is skipped
            warnings.append(str(e))
            summaries.append((path.name, None, None, False, str(e)))
            continue
        summaries.append((path.name, n, width, True, None))
        found = _clusters(v.select(F.col("compound_id").alias("node")), v, block, block["similarity_metric"], config["guards"], warnings)
        if found is not None:
            named = found.withColumn("_k", F.concat_ws("/", F.lit(path.name), "parameter_set_id", "cluster")).withColumnRenamed("node", "compound_id")
            parts.append(groups.keyed_groups(named, "compound_id", "_k", f"SIM_{len(summaries)}", "similarity", block["min_cluster_size"]))
    wanted = [n for n in ("murcko_group_builder", "mcs_group_builder", "brics_recap_fragment_builder", "similarity_group_builder") if build[n]["enabled"]]
    excluded, figures, structure, tier = None, {}, None, None
    if wanted and structures._BACKENDS:
        structure, tier, more = _structure(df, key)
        warnings += more
        if structure is None:
            warnings.append("no structure column; structure builders skipped")
        else:
            mols, excluded = structures.split(df.select("compound_id", "is_virtual", F.col(f"`{structure}`").alias("input_smiles")), "input_smiles")
            more, figures = _structure_groups(mols, config, warnings)
            parts += more
    else:
        warnings += [f"{n} needs a structure backend; skipped" for n in wanted]
    if not parts:
        raise validate.InputError("no builder made a group")
    members = written(groups.all_memberships(*parts))
    meta, lineage = groups.meta_groups(members, build["meta_group_builder"]["min_jaccard"], build["meta_group_builder"]["max_meta_groups"])
    everything = written(members.unionByName(meta))
    kept, report = groups.final_filter(everything, config["group_filters"]["min_compound_count"], config["group_filters"]["apply_to_sources"])
    kept = written(kept)
    reg = written(groups.registry(kept, compounds))
    rel = written(groups.typed_relations(written(groups.relations(kept, config["relations"]["min_jaccard"], config["relations"]["max_relations"])), kept, lineage))
    ids = [r["group_id"] for r in reg.select("group_id").collect()]
    out = Path(outdir)
    sinks.write_table(kept, str(out / "group_membership.csv"), overwrite, ["group_id", "compound_id"])
    sinks.write_table(groups.matrix(kept, compounds, ids), str(out / "group_membership_matrix.csv"), overwrite, ["compound_id"])
    sinks.write_table(compounds, str(out / "compounds_master.csv"), overwrite, ["compound_id"])
    sinks.write_table(report, str(out / "group_filter_report.csv"), overwrite, ["membership_source"])
    sinks.write_rows(reg.orderBy("group_id"), str(out / "group_registry.json"))
    nested = rel.select("relation_id", "source_group_id", "target_group_id", "relation_type", F.struct("jaccard_overlap", "shared_compound_count").alias("metrics"))
    sinks.write_rows(nested.orderBy("relation_id"), str(out / "group_relations.json"))
    sinks.write_rows(groups.selection(reg).orderBy("source_priority", "selected_group_id"), str(out / "selected_groups.json"))
    if config["outputs"]["write_graph_packet"]:
        sinks.write_rows(groups.graph_packet(reg, rel), str(out / "graph_packet.json"))
    if config["outputs"]["write_context_aliases"]:
        sinks.write_rows(reg.orderBy("group_id"), str(out / "context_registry.json"))
        sinks.write_table(kept, str(out / "context_membership.csv"), overwrite, ["group_id", "compound_id"])
        sinks.write_rows(nested.orderBy("relation_id"), str(out / "context_relations.json"))
        sinks.write_rows(groups.selection(reg).orderBy("source_priority", "selected_group_id"), str(out / "selected_contexts.json"))
    if excluded is not None:
        sinks.write_table(excluded.select("compound_id", "input_smiles", "exclusion_reason"), str(out / "excluded_compounds.csv"), overwrite, ["compound_id"])
    sinks.write_rows(reg.groupBy("group_source").agg(F.count(F.lit(1)).alias("group_count"), F.max("compound_count").alias("max_compound_count"), F.median("compound_count").alias("median_compound_count")).orderBy("group_source"), str(out / "group_summary.json"))
    sinks.write_json({c: t for c, t in df.dtypes if c not in ("compound_id", "is_virtual")}, str(out / "detected_schema.json"))
    sinks.write_json({"id_column": key, "structure_column": structure, "structure_tier": tier, "grouping_columns": columns if human["enabled"] else []}, str(out / "column_detection_report.json"))
    drawn = {"cores": ["core_counts", "core_pair_counts", "core_heavy_atoms", "core_support"], "core_sweep": ["core_sweep_groups", "core_sweep_sizes"], "clusters": ["cluster_sizes", "cluster_methods", "cluster_count_sensitivity", "cluster_size_sensitivity"]}
    warnings += sinks.write_figures([n for t in figures for n in drawn[t]], figures, str(out / "figures"), cfg.LANDSCAPE["figures"], overwrite)
    counts = {"compounds": compounds.count(), "groups": len(ids), "meta_groups": lineage.select("source_group_id").distinct().count(), "relations": rel.count(), "files": [list(s) for s in summaries]}
    sinks.write_json(sinks.manifest("grouping", config, counts, warnings), str(out / "grouping_manifest.json"))
    sinks.write_json(warnings, str(out / "grouping_warnings.json"))
    return counts | {"warnings": warnings}


def sal(spark: SparkSession, source: str, outdir: str, config: dict[str, Any] | None = None, id_column: str | None = None, overwrite: bool = False) -> dict[str, Any]:
    """Neighbour graphs of every representation, smoothness metrics and ranks."""
    config = cfg.checked(cfg.merged(cfg.LANDSCAPE, config or {}))
    df, key, warnings = _compounds(spark, source, id_column)
    prop = validate.choose_property(df.columns, config["property"]["column"], config["property"]["preferred_names"], strict=True)
    compounds = written(validate.valid_property(df, prop).select("compound_id", "property"))
    dropped = df.count() - compounds.count()
    if dropped:
        warnings.append(f"{dropped} rows without a number in {prop}")
    found, more = tables.matched(tables.representation_files(config["description_inputs"], Path(source).stem), config["representations"])
    warnings += more
    edges, facts = None, []
    for name, path, block in found:
        try:
            v, width, more = _vectors(spark, path, compounds, block.get("scaling", "none"), config["feature_processing"]["drop_constant_features"])
        except validate.InputError as e:
            warnings.append(str(e))
            continue
        warnings += more
        e = neighbours.with_property(neighbours.knn(written(v), "compound_id", block["metric"], config["knn"]["k"]), compounds).withColumn("representation_id", F.lit(name)).withColumn("descriptor_file", F.lit(path.name))
        e = written(e)
        edges = e if edges is None else edges.unionByName(e)
        facts.append((name, path.name, block["metric"], block.get("scaling", "none"), width))
    if edges is None:
        raise validate.InputError("no representation can be used")
    edges = written(edges)
    info = spark.createDataFrame(facts, "representation_id string, descriptor_file string, metric string, scaling string, feature_count int")
    eps, own = config["sali"]["epsilon"], config["knn"]["include_self_in_local_variance"]
    full = written(landscape.with_sali(edges, eps))
    summary = written(landscape.summary(edges, own, eps))
    files = info.select("representation_id", "descriptor_file")
    out = Path(outdir)
    for table, name, order in (
        (info.join(summary, "representation_id"), "sal_representation_summary.csv", ["primary_comparison_rank"]), (full, "sal_knn_edges.csv", ["representation_id", "compound_id", "neighbor_rank"]),
        (landscape.local_metrics(edges, own).join(files, "representation_id"), "sal_local_metrics.csv", ["representation_id", "compound_id"]),
        (landscape.distribution(full).join(files, "representation_id"), "sal_sali_distribution.csv", ["representation_id"]), (landscape.metric_ranking(summary).join(files, "representation_id"), "sal_metric_ranking.csv", ["metric_name", "rank"]),
    ):
        sinks.write_table(table, str(out / name), overwrite, order)
    if config["property_stratification"]["enabled"]:
        q = config["property_stratification"]
        sinks.write_table(landscape.strata(compounds, *q["quantiles"], q["labels"]), str(out / "sal_property_strata.csv"), overwrite, ["compound_id"])
    shown = {"summary": summary, "edges": full, "local": landscape.local_metrics(edges, own), "ranking": landscape.metric_ranking(summary)}
    names = ["primary_comparison", "normalized_sali_distribution", "sali_ranking", "distance_vs_delta", "local_variance_vs_property", "auxiliary_metrics"]
    warnings += sinks.write_figures(names, shown, str(out / "figures"), config["figures"], overwrite)
    counts = {"compounds": compounds.count(), "representations": len(facts), "edges": edges.count()}
    sinks.write_json(sinks.manifest("landscape", config, counts, warnings), str(out / "sal_manifest.json"))
    sinks.write_json(warnings, str(out / "sal_warnings.json"))
    return counts | {"warnings": warnings}


def group_insight(spark: SparkSession, source: str, groups_dir: str, outdir: str, config: dict[str, Any] | None = None, id_column: str | None = None, bits_file: str | None = None, overwrite: bool = False) -> dict[str, Any]:
    """Profiles, tests, diversity, overlap and ranks of the groups of a grouping run."""
    config = cfg.merged(cfg.INSIGHT, config or {})
    df, key, warnings = _compounds(spark, source, id_column)
    prop = validate.choose_property(df.columns, config["property"]["column"], config["property"]["preferred_names"], strict=False)
    compounds = written(validate.valid_property(df, prop).select("compound_id", "property"))
    inputs = config["group_inputs"]
    members = written(tables.read_membership_matrix(spark, str(Path(groups_dir) / inputs["membership_matrix"])).join(compounds, "compound_id"))
    registry, lacking = tables.read_registry(spark, str(Path(groups_dir) / inputs["registry"]), members)
    if n := lacking.count():
        warnings.append(f"{n} groups aren't in the registry")
    bits = None
    if bits_file and Path(bits_file).exists():
        raw = tables.read_representation(spark, bits_file)
        columns = validate.feature_columns(raw)
        bits = features.packed(raw, "compound_id", columns).select("compound_id", features.sign_bits(F.col("features"), len(columns)).alias("words"))
    else:
        warnings.append("no bit vectors; structural diversity isn't available")
    all_ = insight.analysed(members, compounds, registry, bits, config).drop("_high", "_low")
    tests = config["statistics"]
    if tests["enabled"] and tests["permutation_test"]:
        all_ = all_.join(stats.permutation_p(members, "group_id", "property", compounds, tests["permutation_count"]), "group_id", "left")
    all_ = written(all_)
    bins, higher = config["activity_bins"], config["property"]["higher_is_better"]
    cuts = insight.thresholds(compounds, bins["high_quantile"], bins["low_quantile"], higher)
    out = Path(outdir)
    prefixes = {"group_property_profile.csv": "property_", "group_enrichment_stats.csv": ("high_", "low_", "mannwhitney", "rank_biserial", "u_stat", "mean_shift", "median_shift"), "group_structural_diversity.csv": ("pair_count", "mean_tanimoto", "median_tanimoto", "structural_"), "group_overlap_summary.csv": ("max_jaccard", "overlap_", "redundan")}
    sinks.write_table(all_, str(out / "group_insight_summary.csv"), overwrite, ["insight_priority_rank", "group_id"])
    for name, prefix in prefixes.items():
        sinks.write_table(all_.select("group_id", "group_size", *[c for c in all_.columns if c.startswith(prefix)]), str(out / name), overwrite, ["group_id"])
    sinks.write_table(insight.member_details(members, cuts, higher), str(out / "group_member_details.csv"), overwrite, ["group_id", "compound_id"])
    sinks.write_table(insight.metric_ranking(all_), str(out / "group_metric_ranking.csv"), overwrite, ["metric_name", "rank", "group_id"])
    sinks.write_table(insight.source_summary(all_), str(out / "group_source_summary.csv"), overwrite, ["group_source", "group_type"])
    shown = {"groups": all_, "members": members.join(all_.orderBy("insight_priority_rank", "group_id").limit(config["figures"]["max_groups_per_plot"]).select("group_id"), "group_id"), "sources": insight.source_summary(all_)}
    names = ["enrichment_vs_size", "top_group_distributions", "activity_vs_tanimoto", "diversity_vs_consistency", "source_summary"]
    if bits is None:
        names.remove("activity_vs_tanimoto")
    if config["overlap"]["enabled"]:
        best = written(all_.orderBy("insight_priority_rank", "group_id").limit(config["overlap"]["top_n_for_heatmap"]).select("group_id"))
        shown["overlaps"] = insight.overlaps(members.join(best, "group_id", "left_semi"))
        names.append("overlap_heatmap")
    points = {**config["figures"], "max_points_per_plot": cfg.LANDSCAPE["figures"]["max_points_per_plot"]}
    warnings += sinks.write_figures(names, shown, str(out / "figures"), points, overwrite)
    related = tables.read_relations(spark, str(Path(groups_dir) / inputs["relations"]))
    sinks.write_table(related.groupBy("relation_type").agg(F.count(F.lit(1)).alias("relation_count")), str(out / "group_relation_summary.csv"), overwrite, ["relation_type"])
    (out / "top_groups_report.md").write_text(sinks.report(all_, config["ranking"]["top_n_report"]))
    counts = {"compounds": compounds.count(), "groups": all_.count()}
    sinks.write_json(sinks.manifest("insight", config, counts, warnings), str(out / "insight_manifest.json"))
    sinks.write_json(warnings, str(out / "insight_warnings.json"))
    return counts | {"warnings": warnings}


def main(argv: list[str] | None = None) -> dict[str, Any]:
    p = argparse.ArgumentParser(prog="groveline")
    sub = p.add_subparsers(dest="run", required=True)
    for name in ("describe", "grouping", "landscape", "insight"):
        s = sub.add_parser(name)
        for flag in ("--input", "--outdir"):
            s.add_argument(flag, required=True)
        for flag in ("--config", "--id-column"):
            s.add_argument(flag)
        s.add_argument("--overwrite", action="store_true")
        if name == "describe":
            s.add_argument("--sets", nargs="*")
            s.add_argument("--smiles-column")
            s.add_argument("--enable-3d", action="store_true")
            s.add_argument("--dry-run", action="store_true")
            s.add_argument("--model-registry")
            s.add_argument("--model-dir", action="append", help="ID=PATH, more than once for more sets")
        if name in ("describe", "grouping"):
            s.add_argument("--backend", help="module:attribute that makes a structure backend; each worker imports it")
        if name == "grouping":
            s.add_argument("--grouping-columns", nargs="*")
            s.add_argument("--is-virtual-column")
        if name == "insight":
            s.add_argument("--groups-dir", required=True)
            s.add_argument("--bits-file")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("groveline").getOrCreate()
    if getattr(a, "backend", None):
        structures.register_backend(a.backend, a.backend)
    if a.run == "describe":
        return describe(spark, a.input, a.outdir, a.sets, a.enable_3d, a.id_column, a.smiles_column, a.overwrite, a.dry_run, a.model_registry, a.model_dir)
    user = cfg.load({}, a.config)
    if a.run == "grouping":
        return grouping(spark, a.input, a.outdir, user, a.id_column, a.grouping_columns, a.is_virtual_column, a.overwrite)
    if a.run == "landscape":
        return sal(spark, a.input, a.outdir, user, a.id_column, a.overwrite)
    return group_insight(spark, a.input, a.groups_dir, a.outdir, user, a.id_column, a.bits_file, a.overwrite)


if __name__ == "__main__":
    main()
