"""Column expressions: activations, losses, linear outputs and metric aggregates."""
