"""Readers and writers of session logs, states, manifests, configurations and event streams."""
