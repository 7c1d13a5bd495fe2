"""Model providers: a small interface, a registry, and a deterministic one without a network."""

from __future__ import annotations

from collections.abc import Callable

from .base import Provider
from .offline import OfflineProvider

_registry: dict[str, Callable[..., Provider]] = {"offline": OfflineProvider}


def register(name: str, make: Callable[..., Provider]) -> None:
    """make() runs once in each worker; it must be importable there or picklable."""
    _registry[name.lower()] = make


def make(name: str = "offline", **options) -> Provider:
    if (key := name.strip().lower()) not in _registry:
        raise ValueError(f"no provider {name}; there are {', '.join(sorted(_registry))}")
    return _registry[key](**options)


def maker(name: str) -> Callable[..., Provider]:
    make_it = _registry.get(name.strip().lower())
    if make_it is None:
        raise ValueError(f"no provider {name}")
    return make_it
