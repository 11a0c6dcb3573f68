"""Readers and writers of terrain and alignment formats."""
