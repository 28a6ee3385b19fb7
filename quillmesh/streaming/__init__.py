"""Intentionally empty: the engine's mini-batches are steps of a driver loop over one fixed graph, not a data stream."""
