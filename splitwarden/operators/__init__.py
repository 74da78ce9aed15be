"""DataFrame operators: duplicates, splits, folds, metrics, calibration, experiments, advice."""
