"""Text analysis and strict casts as column expressions."""
