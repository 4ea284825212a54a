def texts_of(df) -> list[tuple]:
    """(doc_id, text) of all rows, null as the empty text."""
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
