"""Archive writers."""
