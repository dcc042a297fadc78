"""Notes, transcripts and questions as Spark tables and streams."""
