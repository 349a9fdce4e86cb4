"""Plugins by stage and name: a plugin is a function (DataFrame, **settings) -> DataFrame. Each stage has columns that its plugins must give, each plugin those that it needs."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

Plugin = Callable[..., DataFrame]

#: The stages, and the columns that each one's result has at least.
STAGES = {"content": ("image", "content_score"), "provenance": ("image", "cred_score"), "propagation": ("image", "early_risk"), "aggregator": ("image", "p2p_risk"), "policy": ("image", "policy")}
_plugins: dict[str, dict[str, Plugin]] = {s: {} for s in STAGES}
_needs: dict[tuple[str, str], tuple[str, ...]] = {}


def register(stage: str, name: str, needs: tuple[str, ...] = ()) -> Callable[[Plugin], Plugin]:
    """Decorator; a second plugin of the same name replaces the first. needs: columns of the input that it can't do without."""
    if stage not in _plugins:
        raise KeyError(f"no stage {stage!r}; there are {', '.join(STAGES)}")

    def add(plugin: Plugin) -> Plugin:
        _plugins[stage][name], _needs[stage, name] = plugin, needs
        return plugin

    return add


def plugin(stage: str, name: str) -> Plugin:
    import tidemark.operators  # noqa: F401  registers the library's own

    try:
        return _plugins[stage][name]
    except KeyError:
        raise KeyError(f"no {stage} plugin {name!r}; there are {', '.join(sorted(_plugins.get(stage, ())))}") from None


def names(stage: str) -> list[str]:
    import tidemark.operators  # noqa: F401

    return sorted(_plugins[stage])


def apply(stage: str, name: str, df: DataFrame, **settings) -> DataFrame:
    """Runs a plugin with those settings that its signature takes; the others are left out. Missing columns of its input, or of its result, are an error while the plan is made."""
    run = plugin(stage, name)
    taken = inspect.signature(run).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in taken.values()):
        settings = {k: v for k, v in settings.items() if k in taken}
    _check(f"{stage} plugin {name!r} needs", _needs.get((stage, name), ()), df)
    out = run(df, **settings)
    _check(f"{stage} plugin {name!r} must give", STAGES[stage], out)
    return out


def _check(what: str, columns: tuple[str, ...], df: DataFrame) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} {', '.join(missing)}; there are {', '.join(df.columns)}")
