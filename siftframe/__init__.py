"""siftframe: a Spark-native table profiling, cleaning and insight engine.

Every operator is a DataFrame-in function built from Spark SQL expressions.
Whole-table statistics are computed in shared scans (one wide aggregate for
all columns) and anything that needs a global order or an exact quantile is
split into bounded, range-bucketed pieces so no single task or the driver
ever holds an unbounded group.
"""

from siftframe.settings import Settings

__all__ = ["Settings"]
__version__ = "0.1.0"
