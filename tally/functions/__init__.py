"""Scalar functions."""

from .parse import *  # noqa: F401,F403
