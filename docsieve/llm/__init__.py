"""Operators of a training-data pipeline: packing, joins, filters, scans, archives.

Nothing outside this subpackage imports it.
"""
