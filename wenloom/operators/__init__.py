"""DataFrame operators, estimators and models."""
