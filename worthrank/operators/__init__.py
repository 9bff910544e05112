"""DataFrame operators: ranking scan, metrics, validation, preparation, encoding, models."""
