"""Runnable plans over the driver's tables, each with its oracle where SQL can state it."""
