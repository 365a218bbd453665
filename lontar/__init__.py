"""lontar: text analytics for Indonesian short documents, expressed as Spark plans."""
