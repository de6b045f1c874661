"""Writers of graph text formats."""
