"""Part of the flowquarry engine."""
