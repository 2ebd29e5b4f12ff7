"""Whole jobs: workload generation, method comparison, metrics, sweeps and profiles."""
