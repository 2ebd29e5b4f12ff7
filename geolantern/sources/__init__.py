"""Readers and writers: points, queries, workloads, embeddings and results."""
