"""Spark-native analytics for dirty sensor event journals.

Every operator is a plain function over DataFrames or Columns, to be used with
``df.transform`` and ``select``.  ``sources`` reads and writes, ``functions``
holds column expressions, ``plans`` the distributed building blocks (calendar
filling, decayed sums, global running totals), ``operators`` the analytics and
``streaming`` the Structured Streaming jobs.
"""
