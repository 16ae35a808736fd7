"""Configurations of runs, and the names of the folders that depend on them."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str | Path) -> dict:
    """A mapping with a stage, from JSON or, where its package is at hand, YAML."""
    path = Path(path)
    text = path.read_text()
    if path.suffix == ".json":
        config = json.loads(text or "{}")
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: YAML cannot be read here, write it as JSON") from e
        config = yaml.safe_load(text) or {}
    if not isinstance(config, dict):
        raise ValueError(f"{path}: not a mapping")
    if "stage" not in config:
        raise ValueError(f"{path}: no stage")
    return config | {"_path": str(path)}


def derived_dir(data: dict) -> str:
    """Folder of what is derived from a data set, its split and what cut it."""
    kind = data.get("dataset", "")
    name = {
        "hotpotqa": "hotpotqa_{split}_n{n_questions}_seed{sample_seed}",
        "syllabusqa": "syllabusqa_chunk{chunk_sents}_{spacy_model}",
        "musique": "musique_dev_{spacy_model}",
    }.get(kind, "{base}_{split}_{spacy_model}")
    return f"{data['data_dir']}/derived/" + name.format(**data, base=str(data.get("hf_id", "")).split("/")[-1])
