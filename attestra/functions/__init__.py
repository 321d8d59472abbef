"""Subpackage of attestra."""
