"""Whole analyses, reports and the driver's queries."""
