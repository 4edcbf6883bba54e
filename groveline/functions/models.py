"""Pretrained models on local disk: a registry of where they are, and loaders that make vectors with them. Nothing is downloaded.

A registry is a file with one entry under ``models`` for each set: loader, model_dir, params, requires_3d. A folder given as ID=PATH
goes before it. A set without a folder, or whose loader needs a package that isn't there, raises MissingBackend; runs record that
and go on with the next set.
"""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.functions import structures
from groveline.functions.structures import SETS, MissingBackend

# Names of loaders, and the packages that each needs.
NEEDS = {
    "huggingface_transformers": ("torch", "transformers"),
    "huggingface_transformers_trust_remote_code": ("torch", "transformers"),
    "unimol_local": ("unimol_tools",),
    "mol2vec_local": ("mol2vec", "gensim", "rdkit"),
    "local_custom": (),
    "external_command": (),
}


@dataclass(frozen=True)
class Model:
    set_id: str
    loader: str = "local_custom"
    model_dir: str | None = None
    requires_3d: bool = False
    params: dict[str, Any] = field(default_factory=dict)


def _entries(path: str) -> dict[str, Any]:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    if importlib.util.find_spec("yaml") is None:
        raise MissingBackend("a YAML registry", "pyyaml (a .json registry needs nothing)")
    import yaml

    return yaml.safe_load(text)


def registry(path: str | None = None, folders: Sequence[str] = ()) -> dict[str, Model]:
    """Models by set id, from a registry file and ID=PATH overrides. An unknown set or loader is an error."""
    out = {}
    for set_id, x in (_entries(path).get("models", {}) if path else {}).items():
        out[set_id] = Model(set_id, x.get("loader") or "local_custom", x.get("model_dir"), bool(x.get("requires_3d")), x.get("params") or {})
    for item in folders:
        set_id, found, folder = item.partition("=")
        if not found:
            raise ValueError(f"a model folder is given as ID=PATH, not {item!r}")
        out[set_id] = replace(out.get(set_id, Model(set_id)), model_dir=folder)
    for m in out.values():
        if m.set_id not in SETS:
            raise ValueError(f"unknown descriptor set {m.set_id}")
        if m.loader not in NEEDS:
            raise ValueError(f"{m.set_id}: unknown loader {m.loader}")
    return out


def ready(model: Model | None, set_id: str) -> Model:
    """The model, if its folder and its loader's packages are there."""
    if model is None or not model.model_dir or not Path(model.model_dir).exists():
        raise MissingBackend(set_id, f"a local model folder ({model.model_dir if model and model.model_dir else 'none is given'})")
    lacking = [p for p in (*NEEDS[model.loader], *(("selfies",) if model.params.get("input_format") == "selfies" else ())) if importlib.util.find_spec(p) is None]
    if lacking:
        raise MissingBackend(f"{set_id} by {model.loader}", ", ".join(lacking))
    return model


def _transformers(model: Model) -> Callable[[list[str]], np.ndarray]:
    import torch
    from transformers import AutoModel, AutoTokenizer

    remote = model.loader.endswith("trust_remote_code")
    tokenizer = AutoTokenizer.from_pretrained(model.model_dir, local_files_only=True, trust_remote_code=remote)
    network = AutoModel.from_pretrained(model.model_dir, local_files_only=True, trust_remote_code=remote).eval()

    def vectors(texts: list[str]) -> np.ndarray:
        batch = tokenizer(texts, padding=True, truncation=True, return_tensors="pt")
        with torch.no_grad():
            hidden = network(**batch).last_hidden_state
        if model.params.get("pooling", "mean_last_hidden_state") == "cls":
            return hidden[:, 0].numpy()
        mask = batch["attention_mask"].unsqueeze(-1).to(hidden.dtype)
        return ((hidden * mask).sum(1) / mask.sum(1).clamp(min=1)).numpy()

    return vectors


def _unimol(model: Model) -> Callable[[list[str]], np.ndarray]:
    from unimol_tools import UniMolRepr

    use = UniMolRepr(data_type="molecule", remove_hs=False, model_path=model.model_dir)
    return lambda texts: np.asarray(use.get_repr(texts, return_atomic_reprs=False)["cls_repr"])


def _mol2vec(model: Model) -> Callable[[list[str]], np.ndarray]:
    from gensim.models import Word2Vec
    from mol2vec.features import mol2alt_sentence
    from rdkit import Chem

    words = Word2Vec.load(str(next(Path(model.model_dir).glob("*.pkl")))).wv
    zero = np.zeros(words.vector_size)
    return lambda texts: np.stack([sum((words[w] for w in mol2alt_sentence(Chem.MolFromSmiles(t), 1) if w in words), zero) for t in texts])


def selfies(texts: Sequence[str]) -> list[str]:
    """Structures as SELFIES, for models that read these."""
    if importlib.util.find_spec("selfies") is None:
        raise MissingBackend("SELFIES input", "selfies")
    from selfies import encoder

    return [encoder(t) for t in texts]


def embedded(df: DataFrame, model: Model | None, set_id: str, folder: str, key: str = "compound_id") -> DataFrame:
    """key, features of every row of df (key, canonical_smiles). folder: where an external command's files go.

    A worker loads the model once for each task. The loader must give one vector for each row.
    """
    model = ready(model, set_id)
    if model.loader == "local_custom":
        return structures.embedded(df, model.model_dir, model.params, key=key)
    if model.loader == "external_command":
        out = structures.by_command(df.withColumnRenamed(key, "compound_id"), model.params["command"], folder, model.model_dir, model.params.get("timeout_seconds"))
        return out.select(F.col("compound_id").alias(key), F.array(*[F.col(f"`{c}`").cast("double") for c in out.columns if c != "compound_id"]).alias("features"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = {"unimol_local": _unimol, "mol2vec_local": _mol2vec}.get(model.loader, _transformers)(model)
        size = int(model.params.get("batch_size", 32))
        for b in batches:
            texts = b["canonical_smiles"].tolist()
            texts = selfies(texts) if model.params.get("input_format") == "selfies" else texts
            for i in range(0, len(texts), size):
                yield pd.DataFrame({key: b[key].iloc[i : i + size].to_numpy(), "features": list(np.asarray(load(texts[i : i + size]), dtype=float))})

    return df.select(key, "canonical_smiles").mapInPandas(each, f"`{key}` {df.schema[key].dataType.simpleString()}, features array<double>")
