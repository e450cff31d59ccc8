"""Operations of a large-scale training-data pipeline; nothing else in noteframe imports this subpackage."""
