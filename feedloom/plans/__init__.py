"""Whole runs, driver-table views and the query catalogue."""
