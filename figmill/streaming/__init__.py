"""Record files as a stream."""
