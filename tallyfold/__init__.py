"""tallyfold: metric updates folded on Spark, in batch and as a stream.

Counters add up, gauges keep the last write; state is one row per (id, type).
"""

__version__ = "0.1.0"
