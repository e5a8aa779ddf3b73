"""Runs: suggest, confirm, profile, convert."""
