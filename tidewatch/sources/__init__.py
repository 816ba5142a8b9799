"""Readers of raw logs, decoded tables and charts, and writers of results."""
