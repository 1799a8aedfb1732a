"""Text-output analytics on PySpark: captured tool output, logs and transcripts as relations."""
