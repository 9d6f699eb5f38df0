"""Runnable jobs over the given tables; each has a command line and a config file beside it."""
