"""Operators for preparing training text: every module here stands beside the rest of the library."""
