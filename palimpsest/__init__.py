"""Document provenance on Spark: records cut from text, tied to their origin."""
