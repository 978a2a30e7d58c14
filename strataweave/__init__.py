"""Bi-temporal graph and vector analytics as DataFrame plans."""
