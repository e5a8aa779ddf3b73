"""Sources: every reader gives a DataFrame of strings under the source's own headers."""
