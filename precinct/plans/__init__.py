"""Whole analyses: profile, trend, rates and association."""
