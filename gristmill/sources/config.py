"""Settings from a TOML file, and a stable hash of configurations."""

from __future__ import annotations

import hashlib
import json
import tomllib
from enum import Enum
from pathlib import Path

#: What a setting is where the file says nothing.
DEFAULTS = {
    "artifacts": {"pretrained": "artifacts/pretrained"},
    "model": {"default_family": "qwen_vl", "default_size": "tiny"},
    "inference": {"precision": "auto", "max_new_tokens": 128, "image_max_pixels": 1_003_520, "adapter_path": None},
}


def load_settings(path: str | Path) -> dict[str, dict]:
    """The tables of the file over the defaults; an empty adapter path counts as none."""
    with open(path, "rb") as f:
        given = tomllib.load(f)
    out = {name: base | given.get(name, {}) for name, base in DEFAULTS.items()}
    out["inference"]["max_new_tokens"] = int(out["inference"]["max_new_tokens"])
    out["inference"]["image_max_pixels"] = int(out["inference"]["image_max_pixels"])
    out["inference"]["adapter_path"] = out["inference"]["adapter_path"] or None
    out["model"]["path"] = f"{out['artifacts']['pretrained']}/{out['model']['default_size']}"
    return out


def plain(value):
    """Values as JSON has them: sets sorted, enumerations as what they stand for."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(map(plain, value))
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.value if isinstance(value, Enum) else value


def config_hash(config: dict) -> str:
    """SHA-256 of the configuration as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(plain(config), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
