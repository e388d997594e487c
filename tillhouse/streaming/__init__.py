"""Loads that follow a stream of files."""
