"""Feature and rule plugins: functions from bars to bars or signals, with what they need and provide."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..errors import DependencyError, PluginError, ValidationError
from ..model import is_variable_key


@dataclass(frozen=True)
class Plugin:
    """``build`` maps bars (with the columns of required plugins) to bars with more columns, or to
    signals for the kind ``entry``. A feature plugin may give a ``bundle`` instead: what it asks of the pass over the bars
    that all such plugins share (operators.features)."""

    id: str
    version: str
    kind: str  # feature or entry
    build: Callable[..., DataFrame] | None = None
    provides: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)
    enabled: bool = True
    warmup: int = 0  # bars that it needs before it can be used
    bundle: Callable[..., object] | None = None


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Plugins:
    """The plugins of a session: checked when added, ordered by what they need."""

    def __init__(self):
        self._items: dict[str, Plugin] = {}

    def add(self, plugin: Plugin) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9]*(-[a-z0-9]+)*", plugin.id) or not re.fullmatch(r"\d+\.\d+\.\d+", plugin.version):
            raise ValidationError(f"bad id or version: {plugin.id} {plugin.version}")
        if plugin.id in self._items:
            raise PluginError(f"{plugin.id} is registered already")
        if not plugin.build and not plugin.bundle:
            raise PluginError(f"{plugin.id} has nothing to run")
        bad = [k for k in plugin.provides if not is_variable_key(k)]
        owners = {k: p.id for p in self._items.values() for k in p.provides}
        clash = [k for k in plugin.provides if k in owners]
        if bad or clash:
            raise PluginError(f"{plugin.id}: bad keys {bad}" if bad else f"{plugin.id}: {clash[0]} belongs to {owners[clash[0]]}")
        self._items[plugin.id] = plugin

    def enable(self, plugin_id: str, on: bool = True) -> None:
        """Switch a plugin on or off; it keeps its variables either way."""
        if plugin_id not in self._items:
            raise PluginError(f"no plugin {plugin_id}")
        self._items[plugin_id] = replace(self._items[plugin_id], enabled=on)

    def remove(self, plugin_id: str) -> None:
        self._items.pop(plugin_id, None)

    def ordered(self, kind: str = "feature") -> list[Plugin]:
        """Enabled plugins, each after those whose variables it needs; by id where free."""
        live = {p.id: p for p in self._items.values() if p.enabled and p.kind == kind}
        owner = {k: p.id for p in self._items.values() for k in p.provides}
        needs: dict[str, set[str]] = {}
        for p in live.values():
            needs[p.id] = set()
            for key in p.requires:
                if key not in owner:
                    raise DependencyError(f"{p.id} needs {key}, which nothing provides")
                if not self._items[owner[key]].enabled:
                    raise DependencyError(f"{p.id} needs {key} of {owner[key]}, which is disabled")
                if owner[key] != p.id and owner[key] in live:
                    needs[p.id].add(owner[key])
        out: list[Plugin] = []
        while needs:
            ready = sorted(i for i, n in needs.items() if not n)
            if not ready:
                raise DependencyError(f"cycle among {', '.join(sorted(needs))}")
            out.append(live[ready[0]])
            needs.pop(ready[0])
            for n in needs.values():
                n.discard(ready[0])
        return out

    def version(self) -> str:
        """16 hex digits that name the set of features."""
        return hashlib.sha256(stable_json([[p.id, p.version, list(p.provides)] for p in self.ordered()]).encode()).hexdigest()[:16]


def rule_id(plugin: Plugin, config: dict) -> str:
    """A rule with its configuration: another configuration is another rule."""
    return f"{plugin.id}__{hashlib.sha256(stable_json([plugin.id, plugin.version, config]).encode()).hexdigest()[:8]}"
