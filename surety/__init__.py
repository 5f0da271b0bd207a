"""Surety: data-trust signals, trust-gated decisions and decision audit on Spark.

Everything here is a function from DataFrames to DataFrames. Nothing is read,
counted or collected while a plan is being built; the caller decides where the
result goes. Every operator takes an explicit ``as_of`` instant, so a result
can be reproduced later and a record can be re-read as it stood.
"""

from surety.model import Sources, seed_thresholds
from surety.session import configure

__all__ = ["Sources", "seed_thresholds", "configure"]
