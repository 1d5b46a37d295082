"""Part of logloom."""
