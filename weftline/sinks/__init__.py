"""Writers of graph and report formats."""
