"""Readers for every input the engine knows."""
