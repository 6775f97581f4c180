"""Adding notes to a corpus, and indexing them at once if asked."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.notes import render_notes
from ..sources.store import IndexStore
from ..sources.tables import latest_versions


def append_notes(notes: DataFrame, store: IndexStore | None = None) -> DataFrame:
    """Rendered notes as corpus rows. With a store they are indexed too: the notes are a
    delta of the corpus, so nothing else is scanned."""
    documents = latest_versions(render_notes(notes))
    if store is not None:
        store.update(documents, full_listing=False)
    return documents
