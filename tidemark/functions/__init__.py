"""Column functions: scalars, calendars, text, moments and small numerics."""
