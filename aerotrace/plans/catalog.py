"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib
import pkgutil

import aerotrace.plans as plans
from aerotrace.plans.registry import REGISTRY, Query


def load() -> dict[str, Query]:
    for mod in pkgutil.iter_modules(plans.__path__):
        if mod.name.startswith("queries_"):
            importlib.import_module(f"aerotrace.plans.{mod.name}")
    return REGISTRY
