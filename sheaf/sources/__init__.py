"""Documents, records and fields."""
