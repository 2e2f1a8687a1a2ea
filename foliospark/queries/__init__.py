"""Registered queries of the engine's operators over the synthetic tables, with their SQL."""
