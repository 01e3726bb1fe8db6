"""Operators for large text tables: logs, labels, files and mesh text of capture jobs."""
