"""What operators there are and which of them may run."""

from __future__ import annotations

import hashlib
import importlib.util
import itertools
import sys
from collections.abc import Iterable
from dataclasses import dataclass, replace
from pathlib import Path

from ..errors import BAD_REQUEST, CONFLICT, NOT_FOUND, EngineError
from .base import DEFINED, Operator

#: A plugin module states this version and its operators: PLUGIN_VERSION = 1, OPERATORS = [Operator, ...].
PLUGIN_VERSION = 1


@dataclass
class Entry:
    operator: Operator
    active: bool
    source: str = ""


@dataclass
class Plugin:
    id: str
    path: str
    operators: list[Operator]
    active: bool = False
    running: int = 0
    error: str = ""


class OperatorCatalog:
    """Names without regard to case. New operators are inactive until they are activated; built-in ones start active.

    What a name was set to stays when it is registered again.
    """

    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}
        self._plugins: dict[str, Plugin] = {}
        self._count = itertools.count()

    # Operators.

    def upsert(self, operators: Iterable[Operator], active: bool = False, source: str = "") -> None:
        for x in operators:
            held = self._entries.get(x.full.lower())
            self._entries[x.full.lower()] = Entry(x, held.active if held else active, source or (held.source if held else ""))

    def _entry(self, full: str) -> Entry:
        if full.lower() not in self._entries:
            raise EngineError(f"operator not found: {full}", NOT_FOUND)
        return self._entries[full.lower()]

    def set_active(self, full: str, active: bool) -> None:
        self._entry(full).active = active

    def activate(self, full: str) -> None:
        self.set_active(full, True)

    def deactivate(self, full: str) -> None:
        self.set_active(full, False)

    def resolve(self, full: str) -> Operator:
        """404 for an unknown operator, 409 for one that isn't active."""
        entry = self._entry(full)
        if not entry.active:
            raise EngineError(f"operator is deactivated: {full}", CONFLICT)
        return entry.operator

    def delete(self, full: str) -> None:
        if self._entry(full).operator.kind == "builtin":
            raise EngineError(f"built-in operator can't be deleted: {full}", CONFLICT)
        del self._entries[full.lower()]

    def update(self, full: str, description: str) -> None:
        entry = self._entry(full)
        entry.operator = replace(entry.operator, description=description)

    def detail(self, full: str) -> dict:
        entry = self._entry(full)
        x = entry.operator
        return {"category": x.category, "name": x.name, "description": x.description, "position": x.position, "type": x.kind, "plugin": x.plugin, "active": entry.active, "content": entry.source}

    def list(self, kind: str | None = None) -> list[dict]:
        return [self.detail(k) for k, e in sorted(self._entries.items()) if kind in (None, e.operator.kind)]

    # Python files.

    def upload(self, content: str, name: str = "uploaded") -> list[str]:
        """Registers the operators that a Python source defines; returns their names. They start inactive."""
        found = _load_source(content, f"{name}_{next(self._count)}")
        if not found:
            raise EngineError(f"no operator in {name}", BAD_REQUEST)
        self.upsert(found, source=content)
        return [x.full for x in found]

    def discover(self, folder: str) -> dict[str, str]:
        """Registers what the .py files of a folder define, those with a leading underscore aside.

        A file that fails stops none of the others; its error is returned under its name.
        """
        errors = {}
        for path in sorted(Path(folder).glob("*.py")):
            if path.name.startswith("_"):
                continue
            try:
                content = path.read_text()
                self.upsert(_load_source(content, f"{path.stem}_{next(self._count)}"), source=content)
            except Exception as e:
                errors[path.name] = str(e)
        return errors

    def reload(self, folder: str) -> dict[str, str]:
        """Forgets Python operators whose file is gone, keeps which of the others were active."""
        states = {k: e.active for k, e in self._entries.items() if e.operator.kind == "python"}
        for k in states:
            del self._entries[k]
        errors = self.discover(folder)
        for k, active in states.items():
            if k in self._entries:
                self._entries[k].active = active
        return errors

    # Plugins: modules that bring several operators with one life.

    def upload_plugin(self, path: str) -> str:
        """The id is the file's fingerprint, so the same file is the same plugin."""
        data = Path(path).read_bytes()
        ident = hashlib.sha256(data).hexdigest()
        if ident not in self._plugins:
            self._plugins[ident] = Plugin(ident, path, [])
        return ident

    def plugin(self, ident: str) -> Plugin:
        if ident not in self._plugins:
            raise EngineError(f"plugin not found: {ident}", NOT_FOUND)
        return self._plugins[ident]

    def activate_plugin(self, ident: str) -> list[str]:
        """Checks version, symbols, double names and conflicts with other operators; the reason of a failure stays with the plugin."""
        held = self.plugin(ident)
        try:
            spec = importlib.util.spec_from_file_location(f"fluxmere_plugin_{ident[:12]}", held.path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            if getattr(module, "PLUGIN_VERSION", None) != PLUGIN_VERSION:
                raise EngineError(f"plugin version must be {PLUGIN_VERSION}", CONFLICT)
            made = getattr(module, "OPERATORS", None)
            if not made:
                raise EngineError("plugin has no OPERATORS", CONFLICT)
            names = [x.full.lower() for x in made]
            if len(set(names)) < len(names):
                raise EngineError("plugin defines an operator twice", CONFLICT)
            taken = [n for n in names if n in self._entries and self._entries[n].operator.plugin != ident]
            if taken:
                raise EngineError(f"operator conflict: {taken[0]}", CONFLICT)
        except Exception as e:
            held.error = str(e)
            raise e if isinstance(e, EngineError) else EngineError(f"plugin can't be loaded: {e}", CONFLICT) from e
        held.operators = [replace(x, kind="plugin", plugin=ident) for x in made]
        held.active, held.error = True, ""
        for x in held.operators:
            self._entries[x.full.lower()] = Entry(x, True)
        return [x.full for x in held.operators]

    def deactivate_plugin(self, ident: str) -> None:
        held = self.plugin(ident)
        if held.running:
            raise EngineError("plugin is in use", CONFLICT)
        for x in held.operators:
            self._entries.pop(x.full.lower(), None)
        held.active = False

    def delete_plugin(self, ident: str) -> None:
        if self.plugin(ident).active:
            raise EngineError("plugin is active", CONFLICT)
        del self._plugins[ident]


def _load_source(content: str, name: str) -> list[Operator]:
    """Runs a source as a module of its own; its functions are pickled by value, so executors need no file."""
    module = type(sys)(f"fluxmere_user_{name}")
    DEFINED.found.clear()
    try:
        exec(compile(content, f"{name}.py", "exec"), module.__dict__)
    except Exception:
        DEFINED.found.clear()
        raise
    return DEFINED.take()
