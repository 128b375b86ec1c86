"""Cohort extraction, profiling, federated learning and rule mining on PySpark.

Every operator takes and returns DataFrames. See README.md for the map from
operators to modules and for the scaling rules the package follows.
"""

from cohortweave.spec import Criterion, Featureset, SpecError, Variable, from_request

__all__ = ["Criterion", "Featureset", "SpecError", "Variable", "from_request"]
