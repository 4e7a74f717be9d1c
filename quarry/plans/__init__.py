"""The corpus facade, the engine's queries, and their SQL."""
