"""Workflows and the registered queries."""
