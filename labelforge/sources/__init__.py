"""labelforge.sources."""
