"""A Spark-native engine for collections of Markdown documents with structured headers."""
