"""Whole queries over tables, each with the SQL it is held against."""
