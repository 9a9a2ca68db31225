"""Operations of a training-data pipeline over documents, pages and token files, as Spark jobs."""
