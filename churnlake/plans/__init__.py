from churnlake.plans import customers, deciding, evaluating, explaining, modelling, preparing, profiling  # noqa: F401
from churnlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
