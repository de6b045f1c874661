"""Operators over edge tables and node tables."""
