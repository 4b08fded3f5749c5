"""Operations of a training-data pipeline: ten operators and their queries."""
