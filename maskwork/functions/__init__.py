"""Column functions: offsets, text views, validators."""
