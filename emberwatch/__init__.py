"""Incident triage on Spark: parse, embed, match, cluster and report alert logs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from emberwatch.settings import DEFAULTS, KNOWLEDGE, Settings

# Functions sent to Python workers carry their own code, so executors need no installation.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULTS", "KNOWLEDGE", "Settings"]
