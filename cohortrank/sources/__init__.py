"""Scans, contracts and sinks (files) plus the binding of the driver tables."""
