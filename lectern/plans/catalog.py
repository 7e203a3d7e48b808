"""All registered queries."""

from lectern.plans import scoring_queries  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES  # noqa: F401
from lectern.plans import cue_queries  # noqa: F401
from lectern.plans import text_queries  # noqa: F401
from lectern.plans import data_queries  # noqa: F401
from lectern.plans import io_queries  # noqa: F401
