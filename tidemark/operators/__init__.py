"""Version resolution and reads, as plain DataFrame plans."""
