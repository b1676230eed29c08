"""Operations of a training-data pipeline, each written as Spark jobs over whole tables."""
