"""Structured Streaming: continuous inserts, change feeds, latest versions with expiry."""
