"""Table operators on incidents."""
