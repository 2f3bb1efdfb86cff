"""Operations of a training-data pipeline; nothing else in learnspark imports this package."""
