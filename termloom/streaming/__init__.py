"""Release deltas as a stream."""
