"""functions of the factory-floor library."""
