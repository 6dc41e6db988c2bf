"""Part of veclens."""
