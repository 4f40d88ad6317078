"""Log-line sources."""
