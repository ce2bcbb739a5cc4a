"""Composed jobs: populations, preference pairs, arm pairs, allocation, screening."""
