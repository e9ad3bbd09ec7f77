"""Sources: log lines, JSON parsing policies, archives, dataset catalogue."""
