"""All registered queries of the library and the SQL each is checked against."""

from .plans import corpus, experiments, operations, scores, vectors  # noqa: F401
from .plans.base import ORACLES, QUERIES  # noqa: F401
