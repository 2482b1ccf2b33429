"""Named queries over the driver's tables and their SQL twins."""

from . import basic, checks_q, cleaning, explain_q, geo_q, model_q, profile_q, reports, stores_q, text_q  # noqa: F401  (register queries)
from . import oracle_models  # noqa: F401  (registers further SQL twins)
from .oracle import ORACLE
from .registry import QUERIES

__all__ = ["QUERIES", "ORACLE"]
