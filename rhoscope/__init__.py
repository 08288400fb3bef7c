"""Perturbation-quality analytics as lazy Spark plans."""
