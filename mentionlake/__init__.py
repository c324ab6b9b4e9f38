"""mentionlake: media-monitoring analytics expressed as Spark DataFrame plans."""
