"""The registered queries and their SQL."""

from keylattice.plans import composites, rows, tree, units  # noqa: F401
from keylattice.plans.registry import ORACLE, QUERIES  # noqa: F401
