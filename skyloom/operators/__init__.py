"""DataFrame operators: joins, ordered scans, searches, track analytics."""
