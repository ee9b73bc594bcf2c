"""Readers and the incident views."""
