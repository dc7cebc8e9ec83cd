"""Whole plans: operators put together."""
