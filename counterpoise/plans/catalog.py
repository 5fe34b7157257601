"""All registered queries; importing a module registers its queries."""

from . import balance, forests, rows, solvers, texts, vectors  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
