"""postlens: post-listening analytics as Spark DataFrame operators.

Every public function takes and returns ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar helpers), so a caller composes them into one lazy plan
and Catalyst decides pushdown, pruning and join strategy.
"""

__version__ = "0.1.0"
