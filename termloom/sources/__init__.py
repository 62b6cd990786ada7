"""Reading release files and writing line-delimited JSON."""
