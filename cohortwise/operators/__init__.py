"""DataFrame -> DataFrame operators for each stage of the listing pipeline."""
