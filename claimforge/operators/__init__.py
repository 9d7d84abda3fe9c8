"""claimforge.operators."""
