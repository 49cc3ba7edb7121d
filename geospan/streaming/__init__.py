"""Event-time operators."""
