"""Operations of a large-scale training-data pipeline: text, vectors, archives and token files."""
