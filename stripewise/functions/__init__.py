"""Functions of the stripe-index engine."""
