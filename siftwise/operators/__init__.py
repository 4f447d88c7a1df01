"""siftwise operators."""
