"""Representations of chemical structures, behind a backend that may be absent.

Every operator on structure strings goes through a Backend. Without one (this package brings none of its own, and computes no
descriptor values itself) a call raises MissingBackend with the set and the package that it needs; everything after vectors works on
any vectors. Embeddings come from an adapter module in a model folder, or from an external command; nothing is downloaded.
"""

from __future__ import annotations

import importlib
import importlib.util
import subprocess
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.operators.validate import structure_tier
from groveline.storage import written


class MissingBackend(RuntimeError):
    """A set needs a package that isn't installed."""

    def __init__(self, what: str, package: str):
        super().__init__(f"{what} needs {package}, which isn't installed")
        self.what, self.package = what, package


class Backend(Protocol):
    """What a chemistry package has to offer. Each takes one structure string; None stands for one that can't be read."""

    name: str

    def canonical(self, structure: str) -> str | None: ...
    def scaffold(self, structure: str) -> tuple[str, str, int, int]: ...
    def fragments(self, structure: str, method: str) -> list[tuple[str, int]]: ...
    def common_core(self, a: str, b: str, timeout: float) -> tuple[str, int] | None: ...
    def matches(self, structure: str, pattern: str) -> bool: ...
    def vector(self, structure: str, set_id: str, params: dict[str, Any]) -> Sequence[float]: ...

    # for sets in 3D only: a block of coordinates, the path of a file with one, or a tuple that starts with either
    def conformer(self, structure: str, params: dict[str, Any]) -> str | tuple: ...


#: What makes a backend, by name: "module:attribute", which each worker imports, or a callable, which is sent to the workers.
_BACKENDS: dict[str, str | Callable[[], Backend]] = {}


def register_backend(name: str, make: str | Callable[[], Backend]) -> None:
    _BACKENDS[name] = make


def maker(what: str) -> str | Callable[[], Backend]:
    """What makes the backend. Kernels close over it, since a worker doesn't know what the driver has registered."""
    for make in _BACKENDS.values():
        return make
    raise MissingBackend(what, "rdkit (with a registered backend)")


def made(make: str | Callable[[], Backend]) -> Backend:
    if isinstance(make, str):
        module, _, name = make.partition(":")
        make = getattr(importlib.import_module(module), name)
    return make()


@dataclass(frozen=True)
class DescriptorSet:
    set_id: str
    name: str
    category: str
    default: bool = False
    requires_3d: bool = False
    requires_model_dir: bool = False
    requires_external_backend: bool = False
    runtime_tier: str = "light"
    metric: str = "cosine"
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def output(self) -> str:
        return f"{self.set_id}_{self.name}.csv"


def _sets() -> dict[str, DescriptorSet]:
    out: dict[str, DescriptorSet] = {}

    def add(number: int, name: str, category: str, **more: Any) -> None:
        s = DescriptorSet(f"L{number:02d}", name, category, **more)
        out[s.set_id] = s

    # Set numbers, names, sizes and defaults.
    add(1, "rdkit_0d_1d_2d", "rdkit_descriptor", default=True, metric="standardized_euclidean")
    number = 2
    for name, radius, chiral_features in (("ecfp4", 2, False), ("ecfp6", 3, False), ("fcfp4", 2, True)):
        for kind in ("bit", "count"):
            add(number, f"{name}_{kind}", "rdkit_fingerprint", default=True, metric="tanimoto" if kind == "bit" else "cosine", params={"radius": radius, "n_bits": 2048, "use_features": chiral_features, "vector_type": kind})
            number += 1
    add(8, "maccs_keys", "rdkit_fingerprint", default=True, metric="tanimoto", params={"n_bits": 167})
    add(9, "atom_pair", "rdkit_fingerprint", default=True, params={"n_bits": 2048})
    add(10, "topological_torsion", "rdkit_fingerprint", default=True, params={"n_bits": 2048})
    add(11, "rdkit_fragment_counts", "rdkit_descriptor", default=True)
    for n, name in ((14, "rdkit_3d_descriptors"), (15, "usr_usrcat"), (16, "shape_basic")):
        add(n, name, "rdkit_descriptor", requires_3d=True, runtime_tier="medium", metric="standardized_euclidean", params={"conformers": 20, "seed": 61453})
    add(17, "mordred_2d", "mordred_descriptor", runtime_tier="medium", metric="standardized_euclidean")
    add(18, "mordred_3d", "mordred_descriptor", requires_3d=True, runtime_tier="heavy", metric="standardized_euclidean")
    for n, name in ((19, "rdk_path"), (20, "pattern"), (21, "layered"), (22, "avalon"), (23, "morgan_chiral")):
        add(n, name, "rdkit_fingerprint", metric="tanimoto", params={"n_bits": 2048})
    add(24, "pharm2d_folded_bit", "rdkit_reduced_fingerprint", metric="tanimoto", params={"raw_bits": 39972, "n_bits": 2048})
    add(25, "pharm2d_svd", "rdkit_reduced_fingerprint", runtime_tier="heavy", params={"raw_bits": 39972, "target_dim": 1024, "min_dim": 32, "max_dim": 1024, "seed": 61453})
    models = "chemberta molformer grover unimol smi_ted smi_ssed selfies_ted megamolbart chemformer cddd molbert selformer smiles_transformer mol2vec kpgt mole_bert molclr mole mat molecule_text"
    for n, name in enumerate(models.split(), 30):
        add(n, name, "pretrained_embedding", requires_model_dir=True, requires_3d=name == "unimol", requires_external_backend=name == "grover", runtime_tier="heavy")
    add(60, "xtb_single_point", "quantum_chemistry", requires_3d=True, requires_external_backend=True, runtime_tier="heavy", metric="standardized_euclidean")
    return out


SETS = _sets()
#: A category that is planned only: label-trained vectors, kept apart from pretrained ones.
PLANNED_CATEGORIES = ("supervised_task_embedding",)

# Feature families out of scope, as the table of them has it.
COVERAGE = (
    ("Advanced 3D-QSAR field", "CoMFA/CoMSIA-like fields, interaction fields", "Partial/limited", "Use MOE 3D-QSAR and field descriptor functions", "aligned 3D conformers"),
    ("Pharmacophore descriptor", "pharmacophore hypotheses, feature distances", "Partial", "Use MOE pharmacophore functions", "3D conformers"),
    ("pKa/logD/protomer", "predicted pKa, logD, protomer state", "Weak", "Use MOE or another ionization-state predictor", "SMILES/SDF"),
    ("Conformational analysis", "conformer ensemble energy, strain", "Partial", "Use MOE conformational search", "3D conformers"),
    ("Alignment-based descriptor", "alignment-dependent shape/field", "Limited", "Use MOE alignment/QSAR workflow", "aligned 3D conformers"),
    ("Electrostatic field", "surface ESP, field values", "Limited", "Use MOE field descriptors", "3D conformers"),
    ("Receptor-independent pharmacophore", "feature triplets, pharmacophore fingerprints", "Partial", "Use MOE pharmacophore fingerprints", "3D conformers"),
    ("Ligand interaction field", "MIF-like descriptors", "Limited", "Use MOE field analysis", "3D conformers"),
)


def coverage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COVERAGE, "feature_category string, examples string, rdkit_support string, moe_supplementation_plan string, input string")


def selected_sets(asked: Sequence[str] | None = None, enable_3d: bool = False) -> list[DescriptorSet]:
    """The sets to compute: the defaults, or those asked for by id or file name. Sets in 3D need the flag; heavy ones are never implicit."""
    if not asked:
        return [s for s in SETS.values() if s.default or enable_3d and s.requires_3d and s.runtime_tier == "medium"]
    names = {k: s for s in SETS.values() for k in (s.set_id, s.name, f"{s.set_id}_{s.name}")}
    unknown = [a for a in asked if a not in names]
    if unknown:
        raise ValueError(f"unknown descriptor sets: {', '.join(unknown)}")
    chosen = [names[a] for a in asked]
    closed = [s.set_id for s in chosen if s.requires_3d and not enable_3d]
    if closed:
        raise ValueError(f"these sets need 3D to be enabled: {', '.join(closed)}")
    return chosen


def parsed(df: DataFrame, column: str) -> DataFrame:
    """df with canonical_smiles, mol_parse_ok, mol_error. No salts are stripped, nothing is standardised."""
    make = maker("reading structures")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = made(make)
        for b in batches:
            found = [use.canonical(s) if isinstance(s, str) and s.strip() else None for s in b[column]]
            yield b.assign(canonical_smiles=found, mol_parse_ok=[f is not None for f in found], mol_error=[None if f is not None else "can't be read" for f in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(each, f"{fields}, canonical_smiles string, mol_parse_ok boolean, mol_error string")


# How a conformer is made.
CONFORMER = {"num_confs": 20, "random_seed": 61453, "prune_rms_thresh": 0.5, "max_iters": 200, "mmff_variant": "MMFF94s", "fallback_to_uff": True}


def coordinates(found: Any) -> str:
    """A conformer as text, from what a backend gives: the text itself, the path of a file, or a tuple that starts with either."""
    found = found[0] if isinstance(found, tuple) else found
    if not isinstance(found, str) or not found:
        raise ValueError("no conformer")
    return Path(found).read_text() if "\n" not in found and Path(found).is_file() else found


def conformers(df: DataFrame, key: str = "compound_id", **params: Any) -> DataFrame:
    """key, conformer, conformer_error: one conformer of least energy for each structure, by the backend's way with CONFORMER's defaults."""
    make, params = maker("3D conformers"), CONFORMER | params

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = made(make)
        for b in batches:
            found, errors = [], []
            for text in b["canonical_smiles"]:
                try:
                    found.append(coordinates(use.conformer(text, params)))
                    errors.append(None)
                except Exception as e:  # a structure's failure stays in its row
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: b[key], "conformer": found, "conformer_error": errors})

    return df.select(key, "canonical_smiles").mapInPandas(each, f"`{key}` {df.schema[key].dataType.simpleString()}, conformer string, conformer_error string")


def described(df: DataFrame, s: DescriptorSet, key: str = "compound_id") -> DataFrame:
    """key, canonical_smiles, mol_parse_ok, descriptor_error, features. A row that fails has null features and its error; others go on."""
    make = maker(f"{s.set_id} {s.name}")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = made(make)
        for b in batches:
            values, errors = [], []
            for text, ok in zip(b["canonical_smiles"], b["mol_parse_ok"], strict=True):
                try:
                    if ok and s.requires_3d:
                        text = coordinates(use.conformer(text, CONFORMER))
                    values.append([float(x) for x in use.vector(text, s.set_id, s.params)] if ok else None)
                    errors.append(None if ok else "structure can't be read")
                except Exception as e:  # a set's failure stays in its row
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(descriptor_error=errors, features=values)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "canonical_smiles", "mol_parse_ok").mapInPandas(each, f"`{key}` {kind}, canonical_smiles string, mol_parse_ok boolean, descriptor_error string, features array<double>")


def embedded(df: DataFrame, model_dir: str, params: dict[str, Any] | None = None, module: str = "embedding_adapter.py", key: str = "compound_id") -> DataFrame:
    """key, features by a module in the model folder that has embed_smiles(smiles, model_dir, params) or embed_molecules(records, ...).

    The module is loaded once for each worker; it must give one vector for each row.
    """
    path = Path(model_dir) / module
    if not path.exists():
        raise MissingBackend("this embedding", str(path))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spec = importlib.util.spec_from_file_location("embedding_adapter", path)
        mod = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(mod)
        for b in batches:
            if not len(b):
                continue
            if hasattr(mod, "embed_smiles"):
                out = mod.embed_smiles(b["canonical_smiles"].tolist(), model_dir, params or {})
            else:
                out = mod.embed_molecules(b.to_dict("records"), model_dir, params or {})
            vectors = np.asarray(out[0] if isinstance(out, tuple) else out, dtype=float)
            if vectors.ndim != 2 or len(vectors) != len(b):
                raise ValueError(f"the adapter gave {vectors.shape} for {len(b)} rows")
            yield pd.DataFrame({key: b[key], "features": list(vectors)})

    return df.select(key, "canonical_smiles").mapInPandas(each, f"`{key}` {df.schema[key].dataType.simpleString()}, features array<double>")


def by_command(df: DataFrame, command: Sequence[str], folder: str, model_dir: str = "", timeout: float | None = None) -> DataFrame:
    """compound_id and numeric columns by an external command that reads and writes CSV, run on the driver, only where asked for.

    Spark writes the input as parts in ``folder``, which must be one that the driver and the executors share as files; the command runs once for each part, and
    Spark reads what it wrote. No table passes through the driver's memory.
    """
    source, target = Path(folder) / "input", Path(folder) / "output"
    df.select("compound_id", "canonical_smiles").write.mode("overwrite").option("header", True).csv(str(source))
    target.mkdir(parents=True, exist_ok=True)
    for part in sorted(source.glob("part-*.csv")):
        subprocess.run([c.format(input_csv=part, output_csv=target / part.name, model_dir=model_dir) for c in command], check=True, timeout=timeout)
    return df.sparkSession.read.option("header", True).csv(str(target))


# Keys for groups, from structures


def scaffolds(df: DataFrame, key: str = "compound_id") -> DataFrame:
    make = maker("scaffolds")

    def each(batches):
        use = made(make)
        for b in batches:
            rows = [use.scaffold(s) for s in b["canonical_smiles"]]
            yield pd.DataFrame({key: b[key], **{n: [r[i] for r in rows] for i, n in enumerate(("scaffold_smiles", "generic_scaffold_smiles", "scaffold_atoms", "molecule_atoms"))}})

    return df.select(key, "canonical_smiles").mapInPandas(each, f"`{key}` {df.schema[key].dataType.simpleString()}, scaffold_smiles string, generic_scaffold_smiles string, scaffold_atoms long, molecule_atoms long")


def fragments(df: DataFrame, methods: Sequence[str] = ("brics", "recap"), key: str = "compound_id") -> DataFrame:
    """method, fragment, fragment_heavy_atoms, key: one row for each fragment of each structure."""
    make = maker("fragments")

    def each(batches):
        use = made(make)
        for b in batches:
            rows = [(m, f, n, i) for i, s in zip(b[key], b["canonical_smiles"], strict=True) for m in methods for f, n in use.fragments(s, m)]
            yield pd.DataFrame(rows, columns=["method", "fragment", "fragment_heavy_atoms", key])

    return df.select(key, "canonical_smiles").mapInPandas(each, f"method string, fragment string, fragment_heavy_atoms long, `{key}` {df.schema[key].dataType.simpleString()}")


def mined_cores(pairs: DataFrame, timeout: float = 2.0) -> DataFrame:
    """core, heavy_atoms, id_a, id_b. pairs: id_a, smiles_a, id_b, smiles_b. Pairs that time out or have nothing in common are left out."""
    make = maker("common cores")

    def each(batches):
        use = made(make)
        for b in batches:
            rows = []
            for r in b.itertuples():
                found = use.common_core(r.smiles_a, r.smiles_b, timeout)
                if found and found[0]:
                    rows.append((found[0], found[1], r.id_a, r.id_b))
            yield pd.DataFrame(rows, columns=["core", "heavy_atoms", "id_a", "id_b"])

    kind = pairs.schema["id_a"].dataType.simpleString()
    return pairs.mapInPandas(each, f"core string, heavy_atoms long, id_a {kind}, id_b {kind}")


def expanded(cores: Sequence[str], df: DataFrame, key: str = "compound_id") -> DataFrame:
    """core, key: which structures contain which of a bounded list of selected cores."""
    make = maker("substructures")
    cores = list(cores)

    def each(batches):
        use = made(make)
        for b in batches:
            rows = [(c, i) for i, s in zip(b[key], b["canonical_smiles"], strict=True) for c in cores if use.matches(s, c)]
            yield pd.DataFrame(rows, columns=["core", key])

    return df.select(key, "canonical_smiles").mapInPandas(each, f"core string, `{key}` {df.schema[key].dataType.simpleString()}")


def split(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose structure can be read, with canonical_smiles; the others with exclusion_reason), of a written table."""
    every = written(parsed(df, column))
    reason = F.when(F.col(column).isNull() | (F.trim(column) == ""), "no structure").otherwise(F.col("mol_error"))
    return every.where("mol_parse_ok"), every.where("NOT mol_parse_ok").withColumn("exclusion_reason", reason)


def valid_ratio(df: DataFrame, column: str, rows: int = 1000) -> float:
    """Share of a bounded sample's values that parse."""
    return parsed(df.where(F.col(column).isNotNull()).select(column).limit(rows), column).agg(F.avg(F.col("mol_parse_ok").cast("int"))).first()[0] or 0.0


def structure_column(df: DataFrame, named: Sequence[str], others: Sequence[str]) -> tuple[str | None, str | None, list[str]]:
    """(column, tier, warnings): the one whose values parse best, known names first. Without a backend names alone decide."""
    if not _BACKENDS:
        return next(iter(named), None), None, []
    for names in (named, others):
        ratio = {c: valid_ratio(df, c) for c in names}
        best = max(ratio, key=lambda c: ratio[c], default=None)
        if best is not None and structure_tier(ratio[best]) != "low":
            tier = structure_tier(ratio[best])
            return best, tier, [f"structure column {best}: {ratio[best]:.2f} of its values can be read"] if tier == "medium" else []
    return None, "low" if named else None, [f"no column's values can be read as structures: {', '.join(named)}"] if named else []
