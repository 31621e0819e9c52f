"""Training-data operators over a corpus of documents; nothing outside this folder imports it."""
