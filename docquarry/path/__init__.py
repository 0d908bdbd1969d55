"""JSONPath on VARIANT columns: paths become Catalyst expressions."""

from .build import exists, first, nodes, single
from .syntax import PathError, parse

__all__ = ["PathError", "exists", "first", "nodes", "parse", "single"]
