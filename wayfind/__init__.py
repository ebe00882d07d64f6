"""Wayfind: catalog discovery, ranking and replication as Spark DataFrame jobs."""
