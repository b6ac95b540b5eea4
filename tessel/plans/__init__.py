"""Driver-side plans: boolean expressions over sources."""
