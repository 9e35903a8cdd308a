"""Table operators: validation, ranking, splits, scaling and training."""
