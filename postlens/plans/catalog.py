"""Import every query family so the registry is complete."""

from postlens.plans import q_briefs, q_metrics, q_models, q_rows, q_stages, q_stored, q_text, q_titles, q_vectors  # noqa: F401
from postlens.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
