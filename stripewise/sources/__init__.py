"""Sources of the stripe-index engine."""
