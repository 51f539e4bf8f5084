"""plans of the factory-floor library."""
