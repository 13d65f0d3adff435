"""Checked queries by operator family."""

from __future__ import annotations

import importlib
import pkgutil

from .base import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _m not in ("base", "check"):
        importlib.import_module(f"{__name__}.{_m}")
