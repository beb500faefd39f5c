"""quayside: a Spark-native lakehouse engine for loosely typed fuel-trade records.

Every stage is a function from DataFrame to DataFrame (or a Column builder), so the same plan serves
batch jobs, micro-batches and ad-hoc queries. Nothing here runs row-at-a-time Python.
"""

__version__ = "0.1.0"
