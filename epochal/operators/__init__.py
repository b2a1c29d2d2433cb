"""DataFrame-to-DataFrame operators on recordings."""
