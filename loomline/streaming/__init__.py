"""streaming of the factory-floor library."""
