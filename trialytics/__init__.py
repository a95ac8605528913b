"""Staged-trial outcome analytics on PySpark."""
