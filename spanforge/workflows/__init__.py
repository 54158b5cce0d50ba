"""Parameter sampling and outer loops."""
