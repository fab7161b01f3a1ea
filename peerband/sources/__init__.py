"""Reading raw dumps and writing or reading curated tables."""
