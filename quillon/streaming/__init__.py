"""Logs read and appended as streams."""
