"""All queries of this engine but those over text corpora."""

from gridloom.plans import q_annotations, q_boxes, q_grid, q_masks, q_match, q_sources  # noqa: F401
from gridloom.plans.registry import ORACLE, QUERIES  # noqa: F401
