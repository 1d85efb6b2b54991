"""Detectors, sweeps and the reports built on them."""
