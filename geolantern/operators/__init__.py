"""Search, join, sampling, encoding and training operators."""
