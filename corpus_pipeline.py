"""A corpus from raw documents to packed training sequences: five stages, each one of the llm operators.

The stages themselves are in :mod:`palimpsest.llm.stages`; without that subpackage this module can't be imported.
"""

from __future__ import annotations

from palimpsest.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
