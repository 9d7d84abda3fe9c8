"""claimforge.plans."""
