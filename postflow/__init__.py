"""Opportunity-stream analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function.  The clock (``now`` / ``today``) and the rule tables are parameters.
"""
