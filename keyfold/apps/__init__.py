"""Programs over the engine: over any DataFrame, and as functions of (spark, folder of tables), with SQL for their rows."""

from . import numeric, similar, text

QUERIES = text.QUERIES | similar.QUERIES | numeric.QUERIES
WITHOUT_SQL = numeric.WITHOUT_SQL
ORACLE_SQL = text.ORACLE_SQL | similar.ORACLE_SQL | numeric.ORACLE_SQL
