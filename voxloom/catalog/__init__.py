"""All runnable queries and the SQL that checks them."""

import importlib

from voxloom.catalog.base import ORACLES, QUERIES

for _m in ("timeline", "recognition", "transcript", "translation", "sound", "state"):
    importlib.import_module(f"voxloom.catalog.{_m}")

__all__ = ["ORACLES", "QUERIES"]
