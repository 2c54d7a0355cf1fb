"""labelforge.plans."""
