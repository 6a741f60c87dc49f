"""Point-in-time analytics for two-sided events (entity A met entity B at time t, with scores)."""
