"""Filters, joins, reports, nested results and batch table jobs."""
