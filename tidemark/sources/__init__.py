"""Scans and sinks: landed files, grids, labelled text, artifacts."""
