"""Landing-zone sources, table sinks and the scratch folder."""
