"""Tables as events."""
