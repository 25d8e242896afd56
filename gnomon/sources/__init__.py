"""Relations the engine reads, and readers for the file formats they come from."""
