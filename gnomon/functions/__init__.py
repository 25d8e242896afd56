"""Sun times as SQL, and what a model returned."""
