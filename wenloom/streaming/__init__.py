"""Scoring of streams: every model's ``transform`` is a stateless plan."""
