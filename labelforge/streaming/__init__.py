"""labelforge.streaming."""
