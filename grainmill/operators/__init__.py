"""Operators over whole tables of raw text columns."""
