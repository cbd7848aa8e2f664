"""Spark-first analytics over points, rays and trajectories."""
