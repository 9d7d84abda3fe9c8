"""claimforge: patent text, product evidence and claim verdicts as Spark jobs."""
