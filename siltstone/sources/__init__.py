"""Readers of source trees, analysis workspaces and telemetry files, and the writers that belong to them."""
