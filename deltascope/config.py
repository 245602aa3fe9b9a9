"""A configuration tree: defaults, deep merge, checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

# Limits and weights that a deployment may override.
DEFAULTS: dict[str, Any] = {"feeds": {"limit": 200, "keep_days": 1}, "throttle": {"hours": 6.0}, "scores": {"materiality": 0.5, "burial": 0.3, "gap": 0.2}, "cache_days": {"filing": 30, "index": 7, "price": 1}}

RULES: dict[str, Callable[[Any], bool]] = {
    "feeds.limit": lambda x: isinstance(x, int) and x > 0, "feeds.keep_days": lambda x: x > 0, "throttle.hours": lambda x: x >= 0,
    "scores": lambda x: abs(sum(x.values()) - 1) < 1e-9, "cache_days": lambda x: all(v > 0 for v in x.values()),
}


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with ``over`` laid on it, branch by branch; lists and leaves are replaced whole."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def lookup(tree: Mapping, path: str) -> Any:
    for part in path.split("."):
        tree = tree[part]
    return tree


def errors(tree: Mapping, rules: Mapping[str, Callable[[Any], bool]] = RULES) -> list[str]:
    """The paths that are missing or break their rule."""
    out = []
    for path, holds in rules.items():
        try:
            if not holds(lookup(tree, path)):
                out.append(path)
        except (KeyError, TypeError, AttributeError):
            out.append(path)
    return out


def load(over: Mapping | None = None) -> dict:
    """The defaults with ``over`` laid on them; raises if a rule is broken."""
    tree = merged(DEFAULTS, over or {})
    if broken := errors(tree):
        raise ValueError(f"configuration: {', '.join(broken)}")
    return tree
