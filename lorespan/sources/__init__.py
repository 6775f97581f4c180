"""Reading corpora and notes, reading and writing index state."""
