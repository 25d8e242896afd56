"""DataFrame operators: de-duplication, winners, transitions."""
