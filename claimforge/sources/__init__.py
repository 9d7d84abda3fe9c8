"""claimforge.sources."""
