"""Match strategies and the shaping of their results."""
