"""Runnable jobs: ``python -m jobs.<name> --config <file> ...``."""
