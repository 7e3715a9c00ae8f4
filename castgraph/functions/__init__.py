"""functions of the core library."""
