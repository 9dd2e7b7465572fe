"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

from docloom.plans import answers_q, cost_q, evidence_q, extensions_q, folds_q, joins_q, layout_q, projection_q, quality_q, rules_q, search_q, shapes_q, source_q, text_q, tree_q, verify_q  # noqa: F401
from docloom.plans.base import ORACLES, QUERIES  # noqa: F401
