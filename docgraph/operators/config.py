"""Settings in layers: defaults, then a user's, then a workspace's, section by section."""

from __future__ import annotations

from typing import Any

DEFAULTS: dict[str, Any] = {
    "chunking": {"least": 30, "long": 50, "most": 3000},
    "search": {"top_k": 10, "depth": 2, "exclude_namespaces": []},
    "inferred": {"threshold": 0.7, "most": 50},
    "hints": {"least": 0.65, "near": 20, "most": 3},
}


def merged(*layers: dict[str, Any] | None) -> dict[str, Any]:
    """Later layers over earlier ones; sections are merged, values and lists replaced."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(*texts: str | None) -> dict[str, Any]:
    """Settings from YAML (or JSON) texts over the defaults."""
    from docgraph.sources.parse import embedded

    layers = [embedded(t, "yaml") for t in texts if t and t.strip()]
    bad = [x for x in layers if not isinstance(x, dict)]
    if bad:
        raise ValueError("settings are a mapping of sections")
    return merged(DEFAULTS, *layers)
