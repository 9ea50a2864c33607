"""foldstone: content-addressed page deduplication and analytics on DataFrames."""
