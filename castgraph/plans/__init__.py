"""plans of the core library."""
