"""Feature sets: typed plugins, pinned by name, version and parameters, checked as a whole before anything is planned.

A plugin is of one kind: `ts` reads an instrument's own bars up to a row, `panel` values published up to a row's date, `cs` the members
of a row's date, `label` looks ahead as far as its horizon says. It states the columns it makes, and those it needs, from its parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from barloom.operators import features as X

KINDS = ("ts", "panel", "cs", "label")
#: Columns that every panel has.
KEYS = ("instrument_id", "trade_date", "bar_idx", "session_idx", "open", "high", "low", "close", "volume")
Names = Callable[..., list[str]]


class PluginError(ValueError):
    """A plugin or a set that can't be used, found before any plan is made."""


@dataclass(frozen=True)
class Plugin:
    """make(df, **parameters) adds the columns; for `panel` it also gets `published`, for `cs` the `member` condition."""

    name: str
    version: int
    kind: str
    make: Callable[..., DataFrame]
    columns: Names
    parameters: dict[str, object] = field(default_factory=dict)
    needs: Names = lambda **_: []
    warmup: Callable[..., int] = lambda **_: 0
    check: Callable[..., str | None] = lambda **_: None


@dataclass(frozen=True)
class Pinned:
    """A plugin with the parameters of a set."""

    plugin: Plugin
    given: dict[str, object]

    @property
    def label(self) -> str:
        return f"{self.plugin.name} {self.plugin.version}"

    @property
    def columns(self) -> list[str]:
        return self.plugin.columns(**self.given)


class Plugins:
    """Plugins by name and version; a version never changes its meaning."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, int], Plugin] = {}

    def add(self, plugin: Plugin) -> None:
        key = (plugin.name, plugin.version)
        if plugin.kind not in KINDS:
            raise PluginError(f"{plugin.name}: no kind {plugin.kind}")
        if isinstance(plugin.version, bool) or not isinstance(plugin.version, int) or plugin.version < 1:
            raise PluginError(f"{plugin.name}: versions are numbers from 1")
        if self._known.get(key, plugin) is not plugin:
            raise PluginError(f"{plugin.name} {plugin.version} is there already")
        self._known[key] = plugin

    def get(self, name: str, version: int) -> Plugin:
        if (name, version) not in self._known:
            others = sorted(v for n, v in self._known if n == name)
            raise PluginError(f"no plugin {name} {version}" + (f", only versions {others}" if others else ""))
        return self._known[name, version]

    def names(self, kind: str | None = None) -> list[tuple[str, int, str]]:
        return sorted((p.name, p.version, p.kind) for p in self._known.values() if kind in (None, p.kind))

    def pinned(self, name: str, version: int, **given: object) -> Pinned:
        """The plugin with given parameters over its own, refused where it doesn't take them."""
        plugin = self.get(name, version)
        if strange := sorted(set(given) - set(plugin.parameters)):
            raise PluginError(f"{name} {version} takes no {strange}, only {sorted(plugin.parameters)}")
        one = Pinned(plugin, {**plugin.parameters, **given})
        if problem := plugin.check(**one.given):
            raise PluginError(f"{name} {version}: {problem}")
        return one


def checked(pins: list[Pinned]) -> list[Pinned]:
    """The set in the order in which it is made, kinds in order: refused if empty, if columns clash or tell an instrument, or if one needs what no other makes."""
    if not pins:
        raise PluginError("a set without plugins")
    maker: dict[str, str] = {}
    for one in pins:
        for c in one.columns:
            if c.lower() in (*KEYS, *X.IDENTIFYING, "id"):
                raise PluginError(f"{one.label}: {c} is a key or tells an instrument")
            if c in maker:
                raise PluginError(f"{c} is made by {maker[c]} and by {one.label}")
            maker[c] = one.label
    ahead = {c for one in pins if one.plugin.kind == "label" for c in one.columns}
    for one in pins:
        needs = one.plugin.needs(**one.given)
        if missing := [c for c in needs if c not in maker and c not in KEYS]:
            raise PluginError(f"{one.label} needs {missing}, which nothing in the set makes")
        if one.plugin.kind != "label" and (seen := [c for c in needs if c in ahead]):
            raise PluginError(f"{one.label} needs {seen}, which look ahead")
    return sorted(pins, key=lambda one: KINDS.index(one.plugin.kind))


def warmup(pins: list[Pinned]) -> int:
    return max((one.plugin.warmup(**one.given) for one in pins), default=0)


def made(df: DataFrame, pins: list[Pinned], published: DataFrame | None = None, member: Column | None = None) -> DataFrame:
    """df with the columns of the set."""
    pins = checked(pins)
    if published is None and any(one.plugin.kind == "panel" for one in pins):
        raise PluginError("the set reads published values, and none are given")
    more = {"panel": {"published": published}, "cs": {"member": member}}
    for one in pins:
        df = one.plugin.make(df, **one.given, **more.get(one.plugin.kind, {}))
    return df


def _windows(df: DataFrame, windows: list[int], f: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    for n in windows:
        df = f(df, n)
    return df


def _positive(windows: list[int]) -> str | None:
    good = windows and len(set(windows)) == len(windows) and all(isinstance(n, int) and n > 0 for n in windows)
    return None if good else "windows are different whole numbers above 0"


def _ranks(df: DataFrame, columns: list[str], least: int, member: Column | None) -> DataFrame:
    for c in columns:
        df = X.cs_rank(df, c, f"{c}_rank", least, member)
    return df


def _published(df: DataFrame, fields: list[str], published: DataFrame) -> DataFrame:
    return df.join(X.known_fundamentals(df, published, fields), ["instrument_id", "trade_date"], "left")


def built_in() -> Plugins:
    """The library's own plugins: every registered feature at its own windows, and those that take parameters."""
    known = Plugins()
    known.add(Plugin("ret", 1, "ts", lambda df, windows: _windows(df, windows, X.ret), lambda windows: [f"ret_{n}" for n in windows], {"windows": [1, 2, 3, 5, 10]}, warmup=lambda windows: max(windows), check=_positive))
    known.add(Plugin("volatility", 1, "ts", lambda df, windows: _windows(df, windows, X.volatility), lambda windows: [f"vol_{n}" for n in windows], {"windows": [60]}, warmup=lambda windows: max(windows) + 1, check=_positive))
    for name, f, n in (("zscore", X.zscore, 20), ("bollinger", X.bollinger, 20), ("volume_spike", X.volume_spike, 20), ("rsi", X.rsi, 14), ("sma_ratio", X.sma_ratio, 200), ("drawdown", X.drawdown, X.YEAR)):
        at_least = lambda n: None if isinstance(n, int) and n > 1 else "n is a whole number above 1"
        known.add(Plugin(name, 1, "ts", lambda df, n, f=f: f(df, n), lambda n, name=name: [name], {"n": n}, warmup=lambda n: n, check=at_least))
    known.add(Plugin("gap", 1, "ts", lambda df: X.gap(df), lambda: ["gap"], warmup=lambda: 1))
    known.add(Plugin("cs_rank", 1, "cs", _ranks, lambda columns, least: [f"{c}_rank" for c in columns], {"columns": [], "least": 1}, lambda columns, least: columns))
    known.add(Plugin("published", 1, "panel", _published, lambda fields: list(fields), {"fields": []}))
    known.add(Plugin("fwd_ret", 1, "label", lambda df, h: X.forward_return(df, h), lambda h: [f"fwd_ret_{h}", f"fwd_end_{h}"], {"h": 5}, check=lambda h: None if isinstance(h, int) and h > 0 else "h is a whole number above 0"))
    return known
