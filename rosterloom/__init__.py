"""rosterloom - semi-structured roster data on Spark.

Every stage is a ``DataFrame -> DataFrame`` function over all jobs at once and
every scalar is a ``Column -> Column`` function, so whole flows stay one lazy
Catalyst plan.
"""

from rosterloom.session import build_session

__all__ = ["build_session"]
