"""Readers of logs, notebooks, maps and street data, and the writers of what comes out."""
