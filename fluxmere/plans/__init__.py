"""Named queries of the engine and their SQL oracles."""
