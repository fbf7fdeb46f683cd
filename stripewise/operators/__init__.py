"""Operators of the stripe-index engine."""
