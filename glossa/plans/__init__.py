"""Sessions, whole analyses and the query catalogue."""
