"""Settings as plain mappings."""

from __future__ import annotations

import json


class Settings(dict):
    """A mapping whose keys can be read as attributes, at any depth."""

    def __getattr__(self, name):
        try:
            value = self[name]
        except KeyError:
            raise AttributeError(name) from None
        return Settings(value) if isinstance(value, dict) else value


def merged(base: dict, over: dict) -> dict:
    """A copy of base in which over wins, level by level."""
    out = {k: merged(v, {}) if isinstance(v, dict) else v for k, v in base.items()}
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str) -> Settings:
    """JSON, or YAML where a YAML library is installed; an empty file has no settings."""
    text = open(path, encoding="utf-8").read()
    if not text.strip():
        return Settings()
    try:
        return Settings(json.loads(text))
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise RuntimeError("reading YAML needs the yaml package; JSON always works") from None
        return Settings(yaml.safe_load(text) or {})


#: The stages' parameters. These are fixed values: thresholds, quotas and grids that results depend on.
DEFAULTS = Settings(
    fusion={"single": 0.9, "consensus": 0.7, "agree": 2},
    forest={"least": 0.55},
    sampling={"total_positives": 200_000, "total_negatives": 400_000, "strata": 4, "hard_negative_max": 0.2, "seed": 0},
    objective="cross_entropy",
    balance=True,
    val_regions=["19NBD"],
    model={"trees": 280, "rate": 0.05, "depth": 6, "least": 200, "share": 0.9, "columns": 0.9, "patience": 50},
    polygons={"least": 0.55, "open_n": 3, "close_n": 5, "min_ha": 0.5},
    grid={"thresholds": [0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7], "opens": [0, 1, 3], "closes": [0, 3, 5, 9], "areas": [0.3, 0.5, 1.0, 2.0]},
)
