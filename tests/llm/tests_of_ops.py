"""Brute-force helpers shared by the tests of this folder."""

from test_operators import brute_components, brute_leaks, brute_spans, table  # noqa: F401
