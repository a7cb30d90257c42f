"""Values that may be errors."""
