"""Plans of the stripe-index engine."""
