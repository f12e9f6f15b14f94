"""Progress lines, metric streams and stateful rules."""
