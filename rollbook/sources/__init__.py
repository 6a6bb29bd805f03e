"""Input contracts, readers, writers and the adapter over the test tables."""
