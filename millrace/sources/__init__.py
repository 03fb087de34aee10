"""Where step tables come from: captured responses, spreadsheets, stored tables."""

from millrace.sources import steps  # noqa: F401
