"""Connected components, shared with the operators."""

from spanloom.operators.components import components, parents

__all__ = ["components", "parents"]
