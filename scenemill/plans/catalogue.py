"""The registry of queries: name -> query over a folder of tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import detection, evaluation, frames, geometry, grouped, integrity, joins, labels, release, spatial, vectors  # noqa: F401  they register
from .registry import ORACLES, QUERIES  # noqa: F401
