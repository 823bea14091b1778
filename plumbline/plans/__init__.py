"""Text to typed logical relations."""
