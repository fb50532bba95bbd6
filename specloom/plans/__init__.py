"""Queries over the driver's tables."""

from specloom.plans import image_queries, peak_queries, spectra_queries  # noqa: F401
