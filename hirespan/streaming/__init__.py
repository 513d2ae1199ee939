"""Structured Streaming jobs; each agrees with its batch form."""
