"""Schemas of the tables that jobs exchange."""

MANIFEST = (
    "relpath string, original_hash string, original_mtime timestamp, language string, "
    "date string, status string, size bigint, source_mtime timestamp, indexed_at timestamp, "
    "chunk_count int, error string"
)
MANIFEST_COLUMNS = [part.split()[0] for part in MANIFEST.split(", ")]
CORPUS = "relpath string, text string, mtime timestamp, size bigint, content_hash string"
TRANSLATIONS = "relpath string, text string"
CHUNKS = (
    "id string, source_file string, section string, date string, language string, "
    "chunk_index int, content string, text string, content_preview string, "
    "embedding array<float>"
)
CHUNK_COLUMNS = [part.split()[0] for part in CHUNKS.split(", ")]
