"""Plans over version logs."""
