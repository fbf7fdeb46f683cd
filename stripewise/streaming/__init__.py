"""Streaming of the stripe-index engine."""
