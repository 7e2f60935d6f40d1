"""Dated-observation analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames.  A *series* is the set of rows of
one key (market, entity, indicator, ...) with at most one row per date, so a
window over a series is bounded by the calendar and never by the number of
input rows; raw ticks are brought to that grain by partial aggregation first
(``operators.market.month_last``, ``sources.landing.daily_last``).
"""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no copy of
# this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
