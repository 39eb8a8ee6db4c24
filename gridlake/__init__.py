"""Race-results analytics as Spark DataFrame operators.

Every public operator takes the race tables, computes all seasons, rounds and
entities in one lazy plan, and takes optional filters that Catalyst pushes to
the scan.
"""

from gridlake.tables import RaceTables, read_tables

__all__ = ["RaceTables", "read_tables"]
