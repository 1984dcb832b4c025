"""A data-quality, profiling and analytics engine over Spark DataFrames.

``run`` answers a suite of checks with as few scans as it can, ``issues`` keeps what failed, ``profile``, ``learn``, ``suite`` and ``compare`` describe tables, ``scan`` and ``mask``
find and hide personal data, ``load`` reads whatever holds a table.
"""

from .operators.drift import compare
from .operators.privacy import mask, scan
from .plans.checks import Check, Measure, issues, run
from .plans.profile import learn, profile, suite
from .sources.readers import load

__all__ = ["Check", "Measure", "compare", "issues", "learn", "load", "mask", "profile", "run", "scan", "suite"]
