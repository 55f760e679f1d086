"""Writers of files that are one document."""
