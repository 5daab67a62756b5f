"""Named analyses (one per reference statement) and their SQL oracle."""
