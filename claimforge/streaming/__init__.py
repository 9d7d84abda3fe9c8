"""claimforge.streaming."""
