"""claimforge.functions."""
