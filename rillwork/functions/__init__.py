"""Subpackage of rillwork."""
