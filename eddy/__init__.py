"""eddy: micro-cluster stream analytics on Spark.

Points are summarised into additive micro-clusters (count, linear and square
sums, time sums) with DataFrame jobs; see README.md for the operator map.
Subpackages: functions (column expressions), sources (tables, text, snapshot
and state I/O), operators (batch operators over points and models), streaming
(the online model, replay and Structured Streaming), plans (registered
queries and their SQL twins).
"""

__version__ = "0.1.0"
