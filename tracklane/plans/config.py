"""Layered settings: ordered deep merge, references and strict overrides."""

from __future__ import annotations

from copy import deepcopy

PREFIX = "GLOBAL."


def merge(*layers: dict) -> dict:
    """Later layers win; nested tables are merged, inputs are left alone."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def get(tree: dict, path: str, default=None):
    for k in path.split("."):
        if not isinstance(tree, dict) or k not in tree:
            return default
        tree = tree[k]
    return tree


def resolve(tree: dict) -> dict:
    """GLOBAL.a.b texts replaced by what stands there; unknown and circular ones stay."""

    def value(v, seen: tuple[str, ...]):
        if isinstance(v, dict):
            return {k: value(x, seen) for k, x in v.items()}
        if isinstance(v, list):
            return [value(x, seen) for x in v]
        if isinstance(v, str) and v.startswith(PREFIX) and v not in seen:
            missing = object()
            found = get(tree, v[len(PREFIX) :], missing)
            return v if found is missing else value(found, (*seen, v))
        return v

    return value(tree, ())


def override(tree: dict, path: str, new) -> dict:
    """A copy with an existing path set anew; an unknown one is a KeyError."""
    out = deepcopy(tree)
    *parents, last = path.split(".")
    at = out
    for k in parents:
        at = at[k]
    if last not in at:
        raise KeyError(path)
    at[last] = new
    return out


def flatten(tree: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in tree.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def read(*paths: str) -> dict:
    """Settings of YAML files, later ones over earlier; files that are not there count as empty. Needs the yaml package."""
    import os

    import yaml

    layers = []
    for p in paths:
        if os.path.exists(p):
            with open(p) as f:
                layers.append(yaml.safe_load(f) or {})
    return merge(*layers)


def put(tree: dict, path: str, new) -> dict:
    """A copy with a path set, whose parents are made where they are missing."""
    out = deepcopy(tree)
    *parents, last = path.split(".")
    at = out
    for k in parents:
        at = at.setdefault(k, {})
    at[last] = new
    return out


def items(pipeline, kind: str) -> list[tuple[int, dict]]:
    """(place, step) of a pipeline's steps (a list, or a table's `pipeline`) of one type."""
    steps = pipeline.get("pipeline") if isinstance(pipeline, dict) else pipeline
    return [(k, s) for k, s in enumerate(steps or []) if s["type"] == kind]


def with_items(pipeline: list[dict], kind: str, change: dict | None = None, to: str | None = None) -> list[dict]:
    """A copy of a pipeline whose steps of one type are changed, or become another type."""
    out = deepcopy(pipeline)
    for _, step in items(out, kind):
        step.update(change or {})
        if to:
            step["type"] = to
    return out


def load(path: str, **settings):
    """What a dotted path names, called with the settings if there are any."""
    from importlib import import_module

    module, _, name = path.rpartition(".")
    found = getattr(import_module(module), name)
    return found(**settings) if settings else found


def controller(mode: str | None, model: str | None) -> str:
    """The camera controller's mode: `rule` by default; `drivegpt` is `gpt` and needs a model."""
    mode = mode or "rule"
    if mode == "drivegpt" and not model:
        raise ValueError("this controller needs a camera model")
    return "gpt" if mode == "drivegpt" else mode
