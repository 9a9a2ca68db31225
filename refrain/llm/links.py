"""Connected components of a link table (the library's own, under the name the operators use)."""

from refrain.operators.linked import components

__all__ = ["components"]
