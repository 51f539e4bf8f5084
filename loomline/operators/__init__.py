"""operators of the factory-floor library."""
