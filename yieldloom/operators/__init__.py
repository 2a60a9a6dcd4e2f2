"""DataFrame-to-DataFrame operators; column names are parameters with domain defaults."""
