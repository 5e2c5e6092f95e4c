"""Operators over canonical tables: spikes, positions, signals and maps."""
