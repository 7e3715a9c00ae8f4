"""sources of the core library."""
