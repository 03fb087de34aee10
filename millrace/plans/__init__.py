"""Plan building: pipelines, history tables and skew-proof window, as-of and range plans."""
