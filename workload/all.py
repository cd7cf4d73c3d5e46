"""Imports every query module so that it registers."""

from . import catalog, pixels, search, temporal, training  # noqa: F401
