"""Feature extraction over streams of payloads."""
