"""Search plans: the standard searches per dialect, and plan inspection."""
