"""Operations of a training-data pipeline: thirteen operators and their registered queries."""
