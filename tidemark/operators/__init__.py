"""DataFrame operators: splits, cohorts, labels, features, matrices, scores, ranks, metrics, selection."""
