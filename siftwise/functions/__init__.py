"""siftwise functions."""
