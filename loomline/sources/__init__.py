"""sources of the factory-floor library."""
