"""Whole runs on small files, the structure gate, and the queries against DuckDB."""

import json
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from groveline import config
from groveline.functions import models, structures
from groveline.operators import clustering
from groveline.plans import runs
from groveline.sources import sinks, tables
from groveline.streaming.maintenance import windowed_groups

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def project(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    rows = [(f"c{i:02d}", "AB"[i % 2] + (";C" if i % 5 == 0 else ""), i * 7 % 10 + (i % 2) * 5, "virtual" if i % 7 == 3 else "wet") for i in range(24)]
    Path("in.csv").write_text("Compound ID,series,pIC50,is_virtual\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    folder = Path("descriptions/in")
    folder.mkdir(parents=True)
    head = "compound_id,canonical_smiles," + ",".join(f"f{k}" for k in range(6))
    body = lambda f: "".join(f"{r[0]},x," + ",".join(str(f(i, k)) for k in range(6)) + "\n" for i, r in enumerate(rows))
    (folder / "L01_rdkit_0d_1d_2d.csv").write_text(head + "\n" + body(lambda i, k: (i * (k + 3)) % 11 + (i % 2) * 9 if k < 5 else 1))
    (folder / "L02_ecfp4_bit.csv").write_text(head + "\n" + body(lambda i, k: (i >> k) & 1))
    (folder / "bad.csv").write_text("compound_id,text\nc01,zz\n")
    return tmp_path


def test_grouping_landscape_insight(spark, project):
    files = {"description_inputs": {"base_dir": str(project / "descriptions")}}
    out = runs.grouping(spark, str(project / "in.csv"), str(project / "groups/in"), files | {"guards": {"hierarchical": 3000, "dbscan": 3000, "louvain": 10000}, "group_builders": {"descriptor_clustering_builder": {"methods": ["butina", "connected_components"], "thresholds": [0.6], "top_k": [3]}}})
    assert out["compounds"] == 24 and out["groups"] >= 3 and any("bad.csv" in w for w in out["warnings"])
    reg = json.loads(Path("groups/in/group_registry.json").read_text())
    assert all(g["compound_count"] >= 5 and g["compound_count"] == g["wet_count"] + g["virtual_count"] for g in reg)
    wide = tables.read_csv(spark, str(project / "groups/in/group_membership_matrix.csv"))
    assert wide.count() == 24 and set(wide.columns[1:]) == {g["group_id"] for g in reg}
    with pytest.raises(Exception, match="exist"):
        runs.grouping(spark, str(project / "in.csv"), str(project / "groups/in"), {"description_inputs": {"enabled": False}})

    out = runs.sal(spark, str(project / "in.csv"), str(project / "analysis/sal"), files | {"knn": {"k": 4}})
    assert out == out | {"compounds": 24, "representations": 2, "edges": 2 * 24 * 4}
    assert tables.read_csv(spark, str(project / "analysis/sal/sal_representation_summary.csv")).count() == 2

    out = runs.group_insight(spark, str(project / "in.csv"), str(project / "groups/in"), str(project / "analysis/insight"), bits_file=str(project / "descriptions/in/L02_ecfp4_bit.csv"))
    got = tables.read_csv(spark, str(project / "analysis/insight/group_insight_summary.csv")).collect()
    assert out["groups"] == len(got) >= 2 and min(int(r["insight_priority_rank"]) for r in got) == 1
    assert "caution" in Path("analysis/insight/top_groups_report.md").read_text()


def test_duplicate_ids_stop_a_run(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,pIC50\na,1\na,2\n")
    with pytest.raises(ValueError, match="duplicate id"):
        runs.sal(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


TOY = """
class Toy:
    name = "toy"  # letters stand for atoms

    def canonical(self, s):
        return "".join(sorted(s)) if s.isalpha() else None

    def vector(self, s, set_id, params):
        if s.startswith("a") and set_id == "L08":
            raise RuntimeError("no")
        return [float(c in s) if set_id == "L02" else float(s.count(c)) for c in "abcdefgh"]

    def conformer(self, s, params):
        if "h" in s:
            raise ValueError("no conformer of h")
        return f"{s}\\n{params['num_confs']} {params['random_seed']}", {"energy": 0.0}

    def scaffold(self, s):
        return s[:1], "*", 1, len(s)

    def fragments(self, s, method):
        return [(c, 4) for c in sorted(set(s))]

    def common_core(self, a, b, timeout):
        both = "".join(sorted(set(a) & set(b)))
        return (both, len(both)) if both else None

    def matches(self, s, pattern):
        return set(pattern) <= set(s)
"""


@pytest.fixture
def toy(spark, tmp_path, monkeypatch):
    """A backend given as a module path, which workers import by themselves."""
    name = f"toy_{tmp_path.name.replace('-', '_')}"
    (tmp_path / f"{name}.py").write_text(TOY)
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    monkeypatch.setattr(structures, "_BACKENDS", {"toy": f"{name}:Toy"})


def test_describe(spark, tmp_path, toy):
    (tmp_path / "in.csv").write_text("compound_id,SMILES\n1,cab\n2,b2\n3,bb\n4,ch\n5,hd\n")
    source = str(tmp_path / "in.csv")
    out = runs.describe(spark, source, str(tmp_path / "out"), ["L02", "L08"])
    assert out["structure_column"] == "SMILES" and out["structure_tier"] == "medium" and out["errors"] == {"L02": 1, "L08": 2}
    errors = {(r["compound_id"], r["descriptor_set"], r["error_type"]) for r in tables.read_csv(spark, str(tmp_path / "out/errors.csv")).collect()}
    assert ("1", "L08", "RuntimeError") in errors and {e[:2] for e in errors} == {("1", "L08"), ("2", "L02"), ("2", "L08")}
    df = tables.read_csv(spark, source)
    assert structures.structure_column(df, [], ["compound_id", "SMILES"])[0] == "SMILES"
    assert structures.structure_column(df, ["compound_id"], []) == (None, "low", ["no column's values can be read as structures: compound_id"])


def test_models_and_conformers(spark, tmp_path, toy):
    (tmp_path / "in.csv").write_text("compound_id,SMILES\n1,cab\n2,b2\n3,bb\n4,ch\n")
    model = tmp_path / "model"
    model.mkdir()
    (model / "embedding_adapter.py").write_text("def embed_smiles(smiles, model_dir, params):\n    return [[len(s), params['x']] for s in smiles]\n")
    (tmp_path / "registry.json").write_text(json.dumps({"models": {"L30": {"loader": "huggingface_transformers", "model_dir": str(model)}, "L40": {"loader": "local_custom", "model_dir": None, "params": {"x": 2}}}}))
    out = runs.describe(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), ["L14", "L30", "L40"], True, registry=str(tmp_path / "registry.json"), model_dirs=[f"L40={model}"])
    assert out["errors"] == {"L14": 2, "L30": 4, "L40": 1}
    got = {r["compound_id"]: r["features"] for r in tables.read_csv(spark, str(tmp_path / "out" / structures.SETS["L40"].output)).collect()}
    assert json.loads(got["1"]) == [3.0, 2.0] and got["2"] is None
    df = spark.createDataFrame([("a", "cab"), ("b", "h")], "compound_id string, canonical_smiles string")
    assert sorted(map(tuple, structures.conformers(df).collect())) == [("a", "cab\n20 61453", None), ("b", None, "ValueError: no conformer of h")]
    (tmp_path / "c.sdf").write_text("block")
    assert structures.coordinates(str(tmp_path / "c.sdf")) == "block"
    for bad in (["L99=/x"], ["L30"]):
        with pytest.raises(ValueError):
            models.registry(None, bad)
    with pytest.raises(structures.MissingBackend, match="selfies"):
        models.selfies(["C"])


def test_all_builders(spark, tmp_path, toy):
    """All seven builders, with relations of all six types, the excluded rows and the figures' rows."""
    words = ["abcde", "abcdf", "abcdg", "abceh", "bcdef", "bcdeg", "bcdfh", "abcdef"]
    lines = [f"c{i:02d},{'' if i == 7 else words[i % 8] + 'h' * (i % 3)},{['A;B', 'A', 'A;B', 'B'][i % 4]},{'xyx'[i % 3]},{i}" for i in range(32)]
    (tmp_path / "in.csv").write_text("compound_id,SMILES,series,class,pIC50\n" + "\n".join(lines) + "\n")
    few = {"methods": ["butina", "connected_components", "louvain"], "thresholds": [0.6], "top_k": [3], "resolutions": [1.0]}
    config = {"description_inputs": {"enabled": False}, "relations": {"min_jaccard": 0.3}, "outputs": {"write_context_aliases": True}, "guards": {"butina": 5}, "group_builders": {
        "human_group_builder": {"grouping_columns": ["series", "class"], "combine_columns": [["series", "class"]]}, "similarity_group_builder": few,
        "mcs_group_builder": {"candidate_min_pair_count": 2, "min_mcs_heavy_atoms": 3}, "meta_group_builder": {"min_jaccard": 0.4}}}
    out = runs.grouping(spark, str(tmp_path / "in.csv"), str(tmp_path / "groups"), config)
    read = lambda n: json.loads((tmp_path / "groups" / n).read_text())
    assert {g["group_source"] for g in read("group_registry.json")} == {"human_column", "murcko", "mcs", "fragment", "similarity", "meta"}
    assert {r["relation_type"] for r in read("group_relations.json")} == {"overlaps_with", "subset_of", "similar_core_to", "derived_from", "meta_group_of", "same_source_as"}
    assert [r["compound_id"] for r in tables.read_csv(spark, str(tmp_path / "groups/excluded_compounds.csv")).collect()] == ["c07"]
    assert any("butina" in w for w in out["warnings"]) and read("column_detection_report.json")["structure_column"] == "SMILES"
    assert read("context_registry.json") == read("group_registry.json") and tables.read_csv(spark, str(tmp_path / "groups/figures/core_sweep_sizes.csv")).count() == 180
    more = runs.group_insight(spark, str(tmp_path / "in.csv"), str(tmp_path / "groups"), str(tmp_path / "insight"), {"statistics": {"permutation_test": True, "permutation_count": 50}})
    summary = tables.read_csv(spark, str(tmp_path / "insight/group_insight_summary.csv"))
    assert more["groups"] == summary.count() and summary.where("permutation_pvalue IS NULL").count() == 0
    assert tables.read_csv(spark, str(tmp_path / "insight/group_source_summary.csv")).count() == 6
    assert tables.read_csv(spark, str(tmp_path / "insight/figures/overlap_heatmap.csv")).count() > 0


def test_guards_come_first(spark):
    nodes = spark.range(9).select(structures.F.col("id").alias("node"))
    for method in ("butina", "leiden", "hierarchical", "louvain"):
        with pytest.raises(clustering.TooLarge, match="guard is 5"):
            clustering.swept(nodes, spark.createDataFrame([], "a long, b long, weight double"), [{"method": method, "threshold": 0.5}], 5)
        assert config.GUARDS[method] > 0


def test_structures(spark, tmp_path):
    (tmp_path / "in.csv").write_text("compound_id,SMILES\n1,cab\n2,b2\n3,bb\n")
    source = str(tmp_path / "in.csv")
    plan = runs.describe(spark, source, str(tmp_path / "out"), dry_run=True)
    assert plan["row_count"] == 3 and plan["sets"] == [f"L{i:02d}" for i in range(1, 12)]
    with pytest.raises(structures.MissingBackend, match="rdkit"):
        runs.describe(spark, source, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="3D"):
        structures.selected_sets(["L14"])
    assert [s.set_id for s in structures.selected_sets(["L24", "pharm2d_svd"])] == ["L24", "L25"] and len(structures.SETS) == 11 + 3 + 9 + 20 + 1
    with pytest.raises(ValueError, match="unknown"):
        structures.selected_sets(["L99"])


def test_adapter(spark, tmp_path):
    df = spark.createDataFrame([("a", "CC"), ("b", "CCC")], "compound_id string, canonical_smiles string")
    with pytest.raises(structures.MissingBackend):
        structures.embedded(df, str(tmp_path))
    (tmp_path / "embedding_adapter.py").write_text("def embed_smiles(smiles, model_dir, params):\n    return [[len(s), 1.0] for s in smiles], {}\n")
    assert sorted((r[0], r[1]) for r in structures.embedded(df, str(tmp_path)).collect()) == [("a", [2.0, 1.0]), ("b", [3.0, 1.0])]
    command = tmp_path / "embed.py"
    command.write_text("import csv, sys\nrows = list(csv.DictReader(open(sys.argv[1])))\nwith open(sys.argv[2], 'w') as f:\n    f.write('compound_id,d\\n' + ''.join(f\"{r['compound_id']},{len(r['canonical_smiles'])}\\n\" for r in rows))\n")
    got = structures.by_command(df, [sys.executable, str(command), "{input_csv}", "{output_csv}"], str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("a", "2"), ("b", "3")]


def test_config():
    c = config.load(config.LANDSCAPE, None, {"knn": {"k": 3}})
    assert c["knn"] == {"k": 3, "include_self_in_local_variance": True} and len(c["representations"]) == 11 and config.LANDSCAPE["knn"]["k"] == 10
    with pytest.raises(ValueError, match="metric"):
        config.load(config.LANDSCAPE, None, {"representations": {"x": {"match": "*", "metric": "odd"}}})


def test_files_and_matches(tmp_path):
    (tmp_path / "s").mkdir()
    for n in ("L02_ecfp4_bit.csv", "errors.csv", "other.csv"):
        (tmp_path / "s" / n).write_text("")
    files = tables.representation_files({**config.FILES, "base_dir": str(tmp_path)}, "s")
    found, warnings = tables.matched(files, {"a": {"match": "L02*.csv"}, "b": {"match": "none.csv"}})
    assert [f.name for f in files] == ["L02_ecfp4_bit.csv", "other.csv"] and [(n, p.name) for n, p, _ in found] == [("a", "L02_ecfp4_bit.csv")] and len(warnings) == 2


def test_figures_need_matplotlib(spark, tmp_path):
    data = sinks.figure_data("sali_ranking", {"summary": spark.createDataFrame([("r", 1.0, 2.0)], "representation_id string, median_sali double, p90_sali double")})
    assert data.count() == 1
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(structures.MissingBackend):
            sinks.draw("sali_ranking", data, str(tmp_path / "f.png"))


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(str(DATA / "events.parquet"))
    want = {(r["event_type"], r["start"]): r["readings"] for r in windowed_groups(events, "event_type", "value", "ts", "1 day").collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(DATA) + "/events*.parquet")
    q = windowed_groups(stream, "event_type", "value", "ts", "1 day").writeStream.outputMode("update").format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["event_type"], r["start"]): r["readings"] for r in spark.table("kept").collect()} == want


def _rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return Counter(tuple(repr(clean(getattr(v, "item", lambda v=v: v)())) for v in row) for row in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("q_")))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert _rows(entry.queries()[name](spark, str(DATA)).toPandas()) == _rows(db.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
