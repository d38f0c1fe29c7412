"""Operations of a training-data pipeline, built on DataFrames; nothing else in the library imports this package."""
