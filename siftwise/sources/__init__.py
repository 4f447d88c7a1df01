"""siftwise sources."""
