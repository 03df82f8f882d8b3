"""Derived frames over the test tables and the registry of checked queries."""
