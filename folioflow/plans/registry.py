"""All queries of the library outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from . import library, relational, segments, structures, text

MODULES = [relational, text, segments, structures, library]
QUERIES: dict = {k: v for m in MODULES for k, v in m.Q.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.O.items()}
