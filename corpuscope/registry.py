"""Extension surface (X4, X6-X8): signals of one's own.

``register``: a function of the profile DataFrame that adds a column of the signal's name.
``register_contextual``: a function of (documents, model) that gives a DataFrame of the signal keyed by
``__row`` (the documents have it beside doc_id; a document is a row), or None to decline. Both kinds take
part in fusion like the built-in signals: by their family, direction and description.
"""

from __future__ import annotations

from collections.abc import Callable

from .constants import FAMILIES, SIGNALS

_own: dict[str, tuple[str, Callable]] = {}
_bound: dict[str, tuple[str, Callable]] = {}
_told: dict[str, tuple[str, int, str]] = {}


def _add(table: dict, name: str, family: str, direction: int, description: str, f: Callable) -> Callable:
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    if direction not in (-1, 1):
        raise ValueError("direction must be -1 or 1")
    if name in _own or name in _bound or name in SIGNALS:
        raise ValueError(f"{name!r} is registered already")
    table[name] = (family, f)
    _told[name] = (family, direction, description or name)
    return f


def register(name: str, family: str, direction: int = 1, description: str = "") -> Callable:
    return lambda f: _add(_own, name, family, direction, description, f)


def register_contextual(name: str, family: str, direction: int = 1, description: str = "") -> Callable:
    return lambda f: _add(_bound, name, family, direction, description, f)


def catalog() -> dict[str, tuple[str, int, str]]:
    """F16: all signals: (family, direction, what it measures), the built-in ones first."""
    return SIGNALS | {name: _told[name] for name in (*_own, *_bound)}


def registered() -> dict[str, tuple[str, Callable]]:
    return dict(_own)


def contextual() -> dict[str, tuple[str, Callable]]:
    return dict(_bound)


def snapshot() -> tuple[dict, dict, dict]:
    return dict(_own), dict(_bound), dict(_told)


def restore(state: tuple[dict, dict, dict]) -> None:
    clear()
    for table, kept in zip((_own, _bound, _told), state, strict=True):
        table.update(kept)


def clear() -> None:
    for table in (_own, _bound, _told):
        table.clear()


def listing() -> dict[str, list[str]]:
    """Families with their signals."""
    out = {f: [s for s, (fam, _, _) in SIGNALS.items() if fam == f] for f in FAMILIES}
    for table in (_own, _bound):
        for name, (family, _) in table.items():
            out[family].append(name)
    return out
