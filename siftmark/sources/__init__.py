"""Where payloads and pairs come from, and where reports go."""
