"""Relational operators over messages, blocks, frames and runs: DataFrame -> DataFrame."""
