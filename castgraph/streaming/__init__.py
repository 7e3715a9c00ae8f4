"""streaming of the core library."""
