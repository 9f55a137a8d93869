"""Drift analytics as Spark DataFrames: gridded fields, spatial joins, Euler steps, trajectories, reports."""
