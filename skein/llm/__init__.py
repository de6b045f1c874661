"""Training-data operators: ten independent operators over a table of documents."""
