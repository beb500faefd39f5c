"""Record-level operators: normalize, validate, classify, dedupe, dead letters, metrics, event queries."""
