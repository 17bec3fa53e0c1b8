"""YAML settings that build on one another."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

import yaml

#: Where the flat lag lists of older files belong now.
FLAT_LAGS = {
    "record_lags": ("record", "lags"),
    "point_differential_lags": ("point_differential", "lags"),
    "location_lags": ("record", "location_lags"),
    "distances_lags": ("distance", "lags"),
    "sos_lags": ("sos", "lags"),
}


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """A new mapping: mappings merge key by key; anything else, lists too, is replaced."""
    both = {k for k in base.keys() & over.keys() if isinstance(base[k], Mapping) and isinstance(over[k], Mapping)}
    return copy.deepcopy({**base, **over}) | {k: merge(base[k], over[k]) for k in both}


def load(path: str | Path, _open: tuple[Path, ...] = ()) -> dict[str, Any]:
    """The file over the files that its ``_include`` names, in their order; paths are relative to the naming file."""
    file = Path(path).resolve()
    if file in _open:
        raise ValueError(f"{file} includes itself")
    if not file.exists():
        raise FileNotFoundError(file)
    try:
        own = yaml.safe_load(file.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ValueError(f"{file}: {e}") from e
    if not isinstance(own, dict):
        raise ValueError(f"{file} holds no settings")
    out: dict[str, Any] = {}
    for name in own.pop("_include", None) or ():
        out = merge(out, load(file.parent / name, (*_open, file)))
    return merge(out, own)


def group_lags(settings: Mapping[str, Any]) -> dict[str, Any]:
    """Settings with flat lag lists moved to where ``FLAT_LAGS`` says; those that have ``features`` stay as they are.

    Flat settings had one list of lags by side for records and point differences, so both groups get it.
    """
    flat = [] if "features" in settings else [k for k in FLAT_LAGS if k in settings]
    if not flat:
        return dict(settings)
    moved = [(*FLAT_LAGS[k], settings[k]) for k in flat]
    moved += [("point_differential", field, lags) for group, field, lags in moved if (group, field) == FLAT_LAGS["location_lags"]]
    features: dict[str, dict[str, Any]] = {}
    for group, field, lags in moved:
        features[group] = features.get(group, {}) | {field: lags}
    return {k: v for k, v in settings.items() if k not in flat and k != "originally_enriched_columns"} | {"features": features}


def get(settings: Mapping[str, Any], dotted: str, default: Any = None) -> Any:
    at: Any = settings
    for key in dotted.split("."):
        if not isinstance(at, Mapping) or key not in at:
            return default
        at = at[key]
    return at


def require(settings: Mapping[str, Any], dotted: Iterable[str]) -> None:
    absent = [d for d in dotted if get(settings, d) is None]
    if absent:
        raise ValueError(f"settings lack {absent}")
