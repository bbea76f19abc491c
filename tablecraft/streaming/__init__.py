"""Watching results: local commits, polling, and structured streams over tables that grow."""
