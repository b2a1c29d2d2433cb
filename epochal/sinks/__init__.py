"""Writers of tables and summaries."""
