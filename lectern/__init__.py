"""Spark jobs over transcripts, subtitle cues, document chunks and dialogue sessions."""
