"""siftwise streaming."""
