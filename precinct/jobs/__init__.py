"""Runnable jobs."""
