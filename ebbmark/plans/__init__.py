"""Whole flows: SQL answers, landing to Gold, and the star-schema views."""
