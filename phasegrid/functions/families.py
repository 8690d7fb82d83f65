"""The registry of model families, the point at which others may add theirs.

A family says how a table is labelled and re-estimated: ``parameters(table, labels, c_bound, c_qual, w)`` and
``log_densities(table, params)``, with parameters that have ``nu``. ``kernels.descend`` and the starts and paths above it
take the family that a table names, or the one that fits its columns; in tasks it must be registered by a module that the
workers import.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from phasegrid.functions import kernels


@dataclass(frozen=True)
class Family:
    name: str
    parameters: Callable
    log_densities: Callable


_FAMILIES: dict[str, Family] = {}


def register(family: Family) -> Family:
    """Add a family; a name that is taken raises."""
    if family.name in _FAMILIES:
        raise ValueError(f"there is a family {family.name}")
    _FAMILIES[family.name] = family
    return family


def unregister(name: str) -> None:
    del _FAMILIES[name]


def family(name: str) -> Family:
    if name not in _FAMILIES:
        raise ValueError(f"no family {name}; there are {', '.join(sorted(_FAMILIES))}")
    return _FAMILIES[name]


def names() -> list[str]:
    return sorted(_FAMILIES)


for _name in ("gaussUniv", "gaussVector", "discreteVector", "gaussAndDiscreteVector"):
    register(Family(_name, kernels.parameters, kernels.log_densities))


def family_of(t: kernels.Table) -> Family:
    """The family that a table names, else the one of its columns."""
    if t.family:
        return family(t.family)
    if t.x.size and t.codes.size:
        return family("gaussAndDiscreteVector")
    return family("discreteVector" if t.codes.size else "gaussUniv" if t.univariate else "gaussVector")


def descend(t: kernels.Table, start, lam: float, c_bound: float, **options) -> kernels.Fit:
    """A descent by the table's family."""
    f = family_of(t)
    return kernels.descend(t, start, lam, c_bound, steps=(f.parameters, f.log_densities), **options)
