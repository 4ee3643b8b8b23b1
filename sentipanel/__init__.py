"""sentipanel: Spark-native text sentiment x market panel analytics.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark SQL / DataFrame primitives, so Catalyst plans,
prunes and pushes down through whole compositions.
"""

__version__ = "0.1.0"
