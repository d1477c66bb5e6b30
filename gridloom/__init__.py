"""Spreadsheet-style table work as Spark jobs."""
